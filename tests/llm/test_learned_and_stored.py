"""Classifiers by held-out accuracy, archives by exact round trips, the pipeline stage by stage."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from text_tables import docs, nothing, prose  # noqa: F401  fixtures

from tallyloom.llm import quality_cnn, toxicity_zstd, warc_zip
from tallyloom.llm.queries import ORACLE, QUERIES


def made_up(spark, seed=4, n=700):
    rng = random.Random(seed)
    parts = ["ka", "lo", "ri", "men", "ta", "su", "pel", "or", "in"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(60, 200))]
        bad, foul = i % 4 == 0, i % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        if foul:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(["wretchpox", "gulmfiend", "dregsnout"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(foul)))
    rows += [(n, None), (n + 1, ""), (n + 2, "é" * 3), (None, "ka lo"), (n + 3, "ka lo ri " * 20_000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, score int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label", [(quality_cnn, "quality"), (toxicity_zstd, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, label):
    docs, labels = made_up(spark)
    learn = F.col("doc_id") % 3 != 0
    scores = {r.doc_id: r.score for r in module.classify(docs, labels, learn).collect()}
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    held = [(scores[r.doc_id] >= 0.3, bool(r[label])) for r in labels.where(~learn).collect()]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    again = {r.doc_id: r.score for r in module.classify(docs.repartition(5), labels, learn).collect()}
    assert again == pytest.approx(scores)


@pytest.mark.parametrize("module, label", [(quality_cnn, "quality"), (toxicity_zstd, "toxic")])
def test_classifiers_without_labels(spark, module, label):
    docs, labels = made_up(spark, n=20)
    scores = module.classify(docs, labels.limit(0), F.lit(True)).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert module.classify(docs.limit(0), labels, F.lit(True)).count() == 0


def test_chunks_and_windows_cover_the_text():
    for n in (0, 1, 3, 64, 96, 97, 160, 256, 257, 449, 5000):
        raw = bytes(i % 251 for i in range(n))
        cut = quality_cnn.chunks(raw)
        assert b"".join(bytes(c[: quality_cnn.STRIDE]) for c in cut[:-1]) + bytes(cut[-1])[: n - (len(cut) - 1) * quality_cnn.STRIDE] == raw
        pieces = toxicity_zstd.windows(raw)
        assert b"".join(p[: toxicity_zstd.STRIDE] for p in pieces[:-1]) + pieces[-1] == raw


def pages(spark):
    rows = [
        (1, "http://a.example/1", "<p>same</p>"),
        (5, "http://a.example/5 x\r\nEvil: y", "<p>same</p>"),
        (3, None, "<p>same</p>"),
        (7, "http://é.example/", ""),
        (8, "http://b.example/", None),
        (9, "http://c.example/", "é\r\n\r\nWARC/1.1 \x00" + "x" * 100_000),
        (9, "http://c.example/", "é\r\n\r\nWARC/1.1 \x00" + "x" * 100_000),
        (10, "http://d.example/", "only"),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string"), rows


@pytest.mark.parametrize("zip64_from, roll", [(0xFFFFFFFF, 1 << 20), (0, 1)])
def test_packages_round_trip(spark, tmp_path, zip64_from, roll):
    frame, rows = pages(spark)
    folder = f"file:{tmp_path}/packages"
    packages = warc_zip.write_packages(warc_zip.classified(frame.repartition(3)), folder, roll, zip64_from)
    packages = spark.createDataFrame(packages.collect(), packages.schema)
    got = warc_zip.read_packages(packages).collect()
    assert len(got) == len(rows) == packages.agg(F.sum("records")).first()[0]
    by_payload = {}
    for page_id, _, html in rows:
        by_payload.setdefault((html or "").encode(), []).append(page_id)
    for r in got:
        payload = next((html or "").encode() for i, _, html in rows if i == r.page_id)
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r.record_type == "revisit") == (r.refers_to is not None) == (r.payload is None)
        assert r.payload in (None, payload) and r.refers_to in (None, max(by_payload[payload]))
    for ids in by_payload.values():
        kinds = [r.record_type for r in got if r.page_id in ids]
        assert kinds.count("response") == 1
    for path in tmp_path.glob("packages/*.zip"):  # another reader agrees
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc_zip.DATA, warc_zip.INDEX}


def test_small_payloads_are_responses(spark):
    frame, _ = pages(spark)
    got = warc_zip.through_packages(frame, min_bytes=12).collect()
    assert [r.record_type for r in got].count("revisit") == 1


def test_packages_of_other_writers():
    raw = warc_zip.record("response", 4, "http://x.example", b"body" * 3000, warc_zip.digest_of(b"body" * 3000), None)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05 a comment"
        z.writestr("archive/x.warc", raw * 3)
        z.writestr("datapackage.json", "{}")
    records = list(warc_zip.Package(pa.BufferReader(held.getvalue())).records())
    assert [warc_zip.parse_record(r)["payload"] for r in records] == [b"body" * 3000] * 3
    with zipfile.ZipFile(held := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/x.warc", raw)
    with pytest.raises(ValueError, match="compressed"):
        list(warc_zip.Package(pa.BufferReader(held.getvalue())).records())
    with pytest.raises(ValueError, match="not a ZIP"):
        warc_zip.Package(pa.BufferReader(b"nothing"))
    with pytest.raises(ValueError, match="digest"):
        warc_zip.parse_record(raw.replace(b"body", b"soul", 1))


def test_no_pages(spark):
    assert warc_zip.through_packages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "ab " * 20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, current = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, current, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{name}.parquet")
        current = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen[name] = current.collect()
        if name != "source_mix":
            assert current.columns == corpus_pipeline.COLUMNS
    ids = {k: [r.doc_id for r in v] for k, v in seen.items()}
    assert 4 not in ids["quality_rules"] and ids["quality_rules"].count(6) == 2 and 12 not in ids["quality_rules"]
    assert ids["near_copies"].count(5) == 1 and 6 not in ids["near_copies"] and None in ids["near_copies"]
    assert set(ids["source_mix"]) <= set(ids["personal_data"]) and len(ids["source_mix"]) > 10
    whole = corpus_pipeline.run(spark, str(tmp_path))
    want = sorted(map(repr, (tuple(r) for r in seen["source_mix"])))
    assert sorted(map(repr, (tuple(r) for r in whole.collect()))) == want
    # A second run leaves the first one's tables alone.
    again = corpus_pipeline.run(spark, str(tmp_path))
    for result in (whole, again):
        assert sorted(map(repr, (tuple(r) for r in result.collect()))) == want


def test_pipeline_of_empty_tables(spark, nothing, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tables_are_noted_by_the_thread_that_settles_them(spark):
    from threading import Thread

    from tallyloom.llm.common import discard, settle, settled_into

    mine, theirs = [], []
    with settled_into(mine):
        other = Thread(target=lambda: theirs.append(settle(spark.range(3), "theirs")))
        other.start()
        other.join()
        own = settle(spark.range(2), "own")
    assert [x.settled_at for x in mine] == [own.settled_at]
    discard(*mine)
    assert theirs[0].count() == 3


def test_every_operator_has_a_query():
    assert sorted(int(k.split("_")[0][2:]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLE) == {k for k in QUERIES if k.split("_")[0] in ("op5", "op8", "op9", "op10", "op13")}
