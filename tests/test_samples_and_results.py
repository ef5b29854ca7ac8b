"""Sample sets in their three forms, and streams with error rows."""

import json

import pytest

from ledgerloom.operators.render import read_order_documents, read_voucher_documents
from ledgerloom.sources import samples
from ledgerloom.streaming import documents


def sample(i: int, **more) -> dict:
    return {"boardTokens": [i % 9] * 81, "focusRow": i, "focusCol": 1, "candidateMask": [i % 2] * 9, "historyOps": [2] * 8, "filledCount": 3, "searchDepth": i, "label": i % 4, **more}


def values(frame) -> list:
    return sorted(map(str, frame.select(*[c.split()[0] for c in samples.SAMPLE.split(", ")]).collect()))


def test_the_same_samples_from_each_form(spark, tmp_path):
    split = lambda i: "eval" if i % 5 == 0 else "train"
    rows = [sample(i, split=split(i)) for i in range(20)]
    inline = tmp_path / "inline.json"
    inline.write_text(json.dumps({"samples": rows, "opLabels": ["a", "b"], "historyWindow": 8}, indent=1))
    for s in ("train", "eval"):
        (tmp_path / f"{s}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows if r["split"] == s))
    lines = tmp_path / "set-manifest.json"
    lines.write_text(json.dumps({"format": samples.LINES, "trainPath": "train.jsonl", "evalPath": "eval.jsonl", "labels": ["a", "b"], "historyWindow": 8, "sampleCounts": {"trainOpSamples": 16, "evalOpSamples": 4}}))
    one = samples.read_samples(spark, str(inline), "opLabels")
    two = samples.read_samples(spark, str(lines), "opLabels")
    samples.write_packed(two, str(lines), "opLabels", 7)
    three = samples.read_samples(spark, str(lines), "opLabels")
    assert three.metadata["format"] == samples.PACKED and samples.read_samples(spark, str(lines), "opLabels", False).metadata["format"] == samples.LINES
    for found in (one, two, three):
        assert found.counts == {"train": 16, "eval": 4} and found.labels == ["a", "b"] and found.metadata["historyWindow"] == 8
        assert (values(found.train), values(found.eval)) == (values(one.train), values(one.eval))
    assert one.train.count() == 16


@pytest.mark.parametrize("wrong", [{"boardTokens": [1] * 80}, {"candidateMask": [1] * 10}, {"historyOps": None}, {"historyOps": [1] * 7 + [None]}])
def test_wrong_widths_end_the_read(spark, tmp_path, wrong):
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"samples": [sample(1, split="train") | wrong], "labels": ["a"]}))
    with pytest.raises(Exception, match=next(iter(wrong))):
        samples.read_samples(spark, str(path), "opLabels").train.collect()


def test_unknown_manifests_are_errors(spark, tmp_path):
    path = tmp_path / "set.json"
    path.write_text('{"format": "other", "labels": ["a"]}')
    with pytest.raises(ValueError, match="unknown form"):
        samples.read_samples(spark, str(path), "opLabels")
    path.write_text('{"samples": []}')
    with pytest.raises(ValueError, match="no labels"):
        samples.read_samples(spark, str(path), "opLabels")
    with pytest.raises(FileNotFoundError):
        samples.read_samples(spark, str(tmp_path / "none-manifest.json"), "opLabels")


def test_a_stream_that_fails_between_its_writes_starts_again(spark, sf, tmp_path):
    docs = read_order_documents(spark, sf).limit(6).collect()
    (tmp_path / "in").mkdir()
    for r in docs:
        (tmp_path / "in" / f"{r['doc_id']}.txt").write_text(r["text"])
    for name, text in (("blank", " \n"), ("none", "nothing here"), ("scan", "%PDF-1.7 stream")):
        (tmp_path / "in" / f"{name}.txt").write_text(text)
    calls = []

    class Broken:
        """A table that cannot be written: the results of the batch are there by then."""

        def __init__(self, table):
            self.table = table

        @property
        def write(self):
            raise RuntimeError("the driver is lost")

    whole = documents.results
    def once(batch, reader):
        found = whole(batch, reader)
        calls.append(1)
        return found | {"errors": Broken(found["errors"])} if len(calls) == 2 else found

    run = lambda: documents.stream_results(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), documents.total_results, 4)
    documents.results = once
    try:
        with pytest.raises(Exception, match="the driver is lost"):
            run().awaitTermination(200)
        assert (tmp_path / "out" / "results" / "batch=1").exists() and not (tmp_path / "out" / "errors" / "batch=1").exists()
        run().awaitTermination(200)
        run().awaitTermination(200)
    finally:
        documents.results = whole
    name = lambda r: r["doc_id"].rpartition("/")[2].removesuffix(".txt")
    good, bad = (spark.read.parquet(str(tmp_path / "out" / k)).collect() for k in ("results", "errors"))
    assert sorted((name(r), r["total_cents"]) for r in good) == sorted((r["doc_id"], r["total"]) for r in docs)
    assert sorted((name(r), r["error"], r["text"]) for r in bad) == [("blank", documents.BLANK, " \n"), ("none", "no total found", "nothing here"), ("scan", documents.BINARY, "%PDF-1.7 stream")]


def test_streamed_records_equal_the_batch(spark, sf, tmp_path):
    docs = read_voucher_documents(spark, sf).select("doc_id", "text").limit(3).collect()
    (tmp_path / "in").mkdir()
    for r in docs:
        (tmp_path / "in" / f"{r['doc_id']}.txt").write_text(r["text"])
    (tmp_path / "in" / "letter.txt").write_text("Dear all,\nplease come.")
    documents.stream_results(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(900)
    name = lambda r: str(r["doc_id"]).rpartition("/")[2].removesuffix(".txt")
    good, bad = (spark.read.parquet(str(tmp_path / "out" / k)).collect() for k in ("results", "errors"))
    assert sorted(map(name, good)) == sorted(str(r["doc_id"]) for r in docs) and [name(r) for r in bad] == ["letter"]
    assert all(json.loads(r["record"])["amounts"]["grand_total_cents"] > 0 for r in good) and bad[0]["error"] and bad[0]["text"].startswith("Dear")
