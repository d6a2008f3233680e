"""Landing files to chunks over restarts, and the framing of progress events."""

from lexweave.sources import files
from lexweave.streaming import ingest


def land(folder, upload, name, text):
    (folder / upload).mkdir(parents=True, exist_ok=True)
    (folder / upload / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def run(spark, tmp_path, parse=files.text_pages):
    q = ingest.start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "chunks"), str(tmp_path / "progress"), str(tmp_path / "check"), parse)
    q.awaitTermination(120)
    assert q.exception() is None
    return {(r["source_file"], r["chunk_index"], r["page_start"], r["page_end"]) for r in spark.read.parquet(str(tmp_path / "chunks")).collect()}


def parse(content):
    if content == b"bad":
        raise ValueError("no pages")
    return files.text_pages(content)


def test_ingest_over_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    land(folder, "u1", "a.pdf", " ".join(["w"] * 360) + "\f" + " ".join(["v"] * 300))
    land(folder, "u2", "B.PDF", "one two\f\fthree")
    land(folder, "u3", "c.txt", "not taken")
    land(folder, "u4", "d.pdf", b"bad")
    first = run(spark, tmp_path, parse)
    assert first == {("a.pdf", 0, 1, 1), ("a.pdf", 1, 1, 2), ("a.pdf", 2, 2, 2), ("B.PDF", 0, 1, 3)}
    assert run(spark, tmp_path, parse) == first
    land(folder, "u5", "a.pdf", "short now")  # a re-upload under its name on a fresh path
    assert run(spark, tmp_path, parse) == {("a.pdf", 0, 1, 1), ("B.PDF", 0, 1, 3)}
    progress = {(r["type"], r["file"]) for r in spark.read.parquet(str(tmp_path / "progress")).collect()}
    assert progress == {("done", "a.pdf"), ("done", "B.PDF"), ("error", "d.pdf")}


def test_listing(spark, tmp_path):
    land(tmp_path, "x", "b.pdf", "1")
    land(tmp_path, "x", "a.PDF", "2")
    land(tmp_path, "x", "n.txt", "3")
    found = files.list_files(spark, str(tmp_path / "x"))
    assert [r["path"].rsplit("/")[-1] for r in found.collect()] == ["a.PDF", "b.pdf"]
    assert files.list_files(spark, str(tmp_path / "x"), limit=1).count() == 1
    assert files.latest_by_name(found).count() == 2


def test_frames():
    sent = ingest.sse_frame('{"a": 1}') + ": beat\n\n" + ingest.sse_frame('{"b": 2}')
    assert ingest.sse_events([sent[:7], sent[7:20], sent[20:]]) == ['{"a": 1}', '{"b": 2}']
    assert ingest.sse_events([sent[:-1]]) == ['{"a": 1}']
