from __future__ import annotations

import json

import pytest

from deckloom.schemas import TABLES
from deckloom.sources.definitions import Format
from deckloom.sources.events import read_events
from deckloom.sources.tables import Store
from deckloom.streaming import ingest, tables

TOKENS = {"modern": ["modern"]}


def put(root, source, day, slug, n):
    folder = root / "Tournaments" / source / "2024" / "01" / day
    folder.mkdir(parents=True, exist_ok=True)
    doc = {"Tournament": {"Date": f"2024-01-{day}T10:00:00Z", "Name": slug, "Uri": ""}, "Decks": [{"Player": str(k)} for k in range(n)]}
    (folder / f"{slug}.json").write_text(json.dumps(doc))


def run(spark, root, out, checkpoint):
    docs = ingest.once(ingest.read_stream(spark, str(root), TOKENS)).select("source", "slug", "raw_ref")
    query = ingest.write_batches(docs, ingest.append_parquet(str(out)), str(checkpoint))
    assert query.awaitTermination(120)
    return sorted((r["source"], r["slug"]) for r in spark.read.parquet(str(out)).collect())


def test_each_document_once(spark, tmp_path):
    root, out, point = tmp_path / "in", tmp_path / "out", tmp_path / "point"
    put(root, "a", "01", "modern-x", 2)
    put(root, "a", "02", "other-x", 2)
    assert run(spark, root, out, point) == [("a", "modern-x")]
    put(root, "a", "03", "modern-x", 2)  # seen before
    put(root, "b", "03", "modern-y", 1)
    assert run(spark, root, out, point) == [("a", "modern-x"), ("b", "modern-y")]


def test_daily_counts(spark, tmp_path):
    for day, n in (("01", 2), ("01", 3), ("20", 1)):
        put(tmp_path, "a", day, f"modern-{n}", n)
    counts = ingest.daily_counts(ingest.read_stream(spark, str(tmp_path), TOKENS))
    query = counts.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    rows = {str(r["day"]): (r["events"], r["decks"]) for r in spark.table("daily").collect()}
    assert rows == {"2024-01-01": (2, 5), "2024-01-20": (1, 1)}


FORMATS = [Format("cards", "modern", True, ("modern",)), Format("cards", "legacy", False, ("legacy",))]
CARDS = [("Bolt", 1), ("Fire", 2)]


def full(root, day, slug, decks):
    put(root, "a", day, slug, 0)
    lines = [[{"CardName": n, "Count": c} for n, c in deck] for deck in decks]
    doc = {"Tournament": {"Date": f"2024-01-{day}", "Name": slug, "Uri": ""}, "Decks": [{"Player": f"p{k}", "Result": "3-1", "Mainboard": x, "Sideboard": []} for k, x in enumerate(lines)]}
    (root / "Tournaments" / "a" / "2024" / "01" / day / f"{slug}.json").write_text(json.dumps(doc))


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = [(k, 1, str(k), n, ("normal", "core", "Instant", 0, None)) for n, k in CARDS]
    store.load_cards(spark.createDataFrame(rows, TABLES["cards"]))
    return store


def state(store):
    return {name: sorted(map(str, store.read(name).collect())) for name in ("events", "decks", "deck_cards", "ingest_unresolved_cards")}


def stream(store, root, point):
    query = tables.import_stream(store, str(root), FORMATS, "cards", str(point), files_per_trigger=1)
    assert query.awaitTermination(300)


def test_batches_go_into_the_tables_once(spark, store, tmp_path):
    root, point = tmp_path / "in", tmp_path / "point"
    full(root, "01", "modern-x", [[("Bolt", 4), ("Nope", 1)], [("Fire", 2)]])
    full(root, "02", "modern-y", [[("Bolt", 1), ("bolt", 2)]])
    full(root, "02", "legacy-z", [[("Bolt", 1)]])
    (root / "Tournaments" / "a" / "2024" / "01" / "02" / "modern-broken.json").write_text('{"Tournament": {"Da')
    stream(store, root, point)
    full(root, "03", "modern-x", [[("Bolt", 4)]])  # seen before
    full(root, "04", "modern-w", [[("Nope", 3)], [("Nope", 1), ("Fire", 1)], []])
    stream(store, root, point)
    events, decks = store.read("events"), store.read("decks")
    assert sorted(r["source_event_id"] for r in events.collect()) == ["modern-w", "modern-x", "modern-y"]
    assert sorted(r["id"] for r in events.collect()) == [1, 2, 3] and sorted(r["id"] for r in decks.collect()) == list(range(1, 7))
    assert decks.join(events.select(events.id.alias("event_id")), "event_id").count() == 6
    assert {(r["card_id"], r["count"]) for r in store.read("deck_cards").collect()} == {(1, 4), (2, 2), (1, 3), (2, 1)}
    assert [(r["card_name"], r["occurrences"], r["decks_affected"]) for r in store.read("ingest_unresolved_cards").collect()] == [("Nope", 3, 3)]
    writer = tables.TableWriter(store, FORMATS, "cards", str(point))
    numbers = sorted(r["batch"] for r in writer.counts().collect())
    assert writer.counts().groupBy().sum("events", "decks", "deck_cards", "unresolved_lines").first() == (3, 6, 4, 3)
    before = state(store)
    docs = read_stream_once(spark, root)
    for number in numbers:
        writer(docs, number)
    assert state(store) == before
    # The same documents in a new batch are known by source and slug.
    writer(docs, max(numbers) + 1)
    assert state(store) == before


def read_stream_once(spark, root):
    return read_events(spark, str(root)).where("not broken").drop("broken")


@pytest.mark.parametrize("where", ["put_files", "put"])
def test_a_batch_that_broke_off_comes_again(spark, store, tmp_path, monkeypatch, where):
    root = tmp_path / "in"
    full(root, "01", "modern-x", [[("Bolt", 4), ("Nope", 1)], [("Fire", 2)]])
    writer = tables.TableWriter(store, FORMATS, "cards", "s")
    writer(read_stream_once(spark, root), 0)
    full(root, "02", "modern-y", [[("Bolt", 1), ("Nope", 2)]])
    docs = read_stream_once(spark, root)
    real, calls = getattr(Store, where), []

    def breaks(self, name, *rest):
        calls.append(name)
        if name in ("decks", "ingest_unresolved_cards"):
            raise OSError("lost")
        return real(self, name, *rest)

    monkeypatch.setattr(Store, where, breaks)
    with pytest.raises(OSError):
        writer(docs, 1)
    monkeypatch.setattr(Store, where, real)
    tables.TableWriter(store, FORMATS, "cards", "s")(docs, 1)
    assert sorted(r["id"] for r in store.read("events").collect()) == [1, 2] and sorted(r["id"] for r in store.read("decks").collect()) == [1, 2, 3]
    assert store.read("deck_cards").count() == 3
    assert [(r["card_name"], r["occurrences"], r["decks_affected"]) for r in store.read("ingest_unresolved_cards").collect()] == [("Nope", 2, 2)]


def test_no_cards_no_stream(spark, tmp_path):
    with pytest.raises(RuntimeError):
        tables.TableWriter(Store(spark, str(tmp_path)), FORMATS, "cards", "s")
