"""Event documents as a stream into the canonical tables.

A batch's events and decks get the numbers after the largest ones in the tables, so ids go on without
gaps. Its files carry the stream's name and the batch's number. A batch that comes again because
its run broke off first takes its own files out of the tables, and one that was finished changes nothing. What a
batch adds to the sums of unresolved names is put in place after the batch is marked as finished; the next batch makes
good what a run left undone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import importer, normalize, resolve
from ..operators.numbering import cut
from ..schemas import TABLES, struct
from ..sources.definitions import Format
from ..sources.events import select_events
from ..sources.tables import Store, upsert_additive
from .ingest import read_stream, write_batches

NAMES = ("events", "decks", "deck_cards")


class TableWriter:
    """Writes batches of documents into a store's tables, each batch once."""

    def __init__(self, store: Store, formats: list[Format], game: str, stream: str):
        self.store, self.stream = store, hashlib.sha256(stream.encode()).hexdigest()[:12]
        own = [f for f in formats if f.game == game]
        self.tokens, self.wanted = {f.name: list(f.slug_tokens) for f in own}, {f.name for f in own if f.imported}
        if store.read("cards").isEmpty():
            raise RuntimeError("there are no cards; load a catalogue first")
        store.swap("games", importer.game_rows(store, game))
        self.game_id = store.read("games").where(F.col("name") == game).first()["id"]
        store.swap("formats", importer.format_rows(store, own, self.game_id))
        self.format_ids = {r["name"]: r["id"] for r in store.read("formats").where(F.col("game_id") == self.game_id).collect()}

    def _mark(self, number: int) -> str:
        return f"{self.store.root}/_batches/{self.stream}-{number:012d}"

    def _finished(self, number: int) -> bool:
        return self.store._there(f"{self._mark(number)}/counts/_SUCCESS")

    def _settle(self, number: int) -> None:
        """Puts the sums of unresolved names of a finished batch in place, if they are not yet."""
        beside = f"{self._mark(number)}/unresolved"
        if number >= 0 and self._finished(number) and self.store._there(f"{beside}/_SUCCESS"):
            self.store.put("ingest_unresolved_cards", beside)

    def counts(self) -> DataFrame:
        """(batch, events, decks, deck_cards, unresolved_lines) of the finished batches of this stream."""
        schema = "batch long, events long, decks long, deck_cards long, unresolved_lines long"
        files, make = self.store._files()
        folder = make(f"{self.store.root}/_batches")
        names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        done = sorted(f"{self.store.root}/_batches/{x}/counts" for x in names if x.startswith(self.stream) and files.exists(make(f"{self.store.root}/_batches/{x}/counts/_SUCCESS")))
        return self.store.spark.read.schema(schema).parquet(*done) if done else self.store.spark.createDataFrame([], schema)

    def __call__(self, docs: DataFrame, number: int) -> None:
        store, spark = self.store, self.store.spark
        self._settle(number - 1)
        if self._finished(number):
            self._settle(number)
            return
        mark = f"{self.stream}-{number:012d}-"
        for name in NAMES:
            store.take_out(name, mark)
        known = store.read("events").select("source", F.col("source_event_id").alias("slug"))
        chosen, _ = select_events(cut(docs), self.tokens, self.wanted)
        chosen = cut(chosen.join(known, ["source", "slug"], "left_anti"))
        next_id = store.read("events").agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
        next_deck = store.read("decks").agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
        placed = cut(normalize.number_events(chosen, next_id, next_deck))
        decks = cut(normalize.decks(placed))
        cards = store.read("cards").where(F.col("game_id") == self.game_id)
        lines = cut(normalize.card_lines(decks))
        deck_cards, missed = resolve.resolve_lines(lines, cut(resolve.resolve_names(lines, cards)))
        missed = cut(missed)
        made = {"events": normalize.events(placed, self.game_id, self.format_ids), "decks": decks, "deck_cards": deck_cards}
        seen, beside = {"batch": number, "unresolved_lines": missed.count()}, {}
        for name in NAMES:
            beside[name], counted = store.stage(name, made[name], {name: "count(1)"})
            seen |= counted
        events = cut(store.staged("events", beside["events"]))
        report = resolve.unresolved_report(missed, decks, events)
        # Cards first: lines without a deck are not read, decks without lines would be.
        for name in reversed(NAMES):
            store.put_files(name, beside[name], mark)
        keys, add = ["game_id", "format_id", "card_name"], ["occurrences", "decks_affected"]
        summed = resolve.numbered_unresolved(upsert_additive(store.read("ingest_unresolved_cards"), report, keys, add))
        typed = summed.select(*[F.col(f.name).cast(f.dataType) for f in struct(TABLES["ingest_unresolved_cards"]).fields])
        typed.write.mode("overwrite").parquet(f"{self._mark(number)}/unresolved")
        order = ["batch", *NAMES, "unresolved_lines"]
        row = spark.createDataFrame([tuple(int(seen[c]) for c in order)], ", ".join(f"{c} long" for c in order))
        row.write.mode("overwrite").parquet(f"{self._mark(number)}/counts")
        self._settle(number)


def import_stream(store: Store, root: str, formats: list[Format], game: str, checkpoint: str, files_per_trigger: int = 500) -> StreamingQuery:
    """Imports the documents below ``root`` that no earlier run of this checkpoint saw, batch by batch, and stops.

    Documents that could not be parsed, of other formats, or whose source and slug an event has already are left out.
    """
    writer = TableWriter(store, formats, game, checkpoint)
    return write_batches(read_stream(store.spark, root, writer.tokens, files_per_trigger), writer, checkpoint)
