import base64
import hashlib
import os

from llm.warc import read_warc, write_warc

ROWS = [
    (i, f"http://x.example/{i}", "<html>" + ("same" if i % 3 == 0 else f"page {i} " * (i % 40)) + "</html>", 1) for i in range(300)
] + [(300, None, None, 1), (301, "a\r\nb", "", 2), (302, "u", "é" * 200_000, 3), (302, "u", "é" * 200_000, 3), (303, "€", "x\r\n\r\ny", 4)]
ROWS += [(302, "other payload of the same id", "<html>page 1 </html>", 5)]


def brute(rows, least=0):
    payloads = [(i, (h or "").encode()) for i, _, h, _ in rows]
    last = {}
    for i, p in payloads:
        last[p] = max(last.get(p, i), i)
    out = []
    for i, p in payloads:
        revisit = len(p) >= least and last[p] != i
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "revisit" if revisit else "response", last[p] if revisit else None))
    return sorted(out, key=repr)


def run(spark, rows, folder, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id long")
    write_warc(pages, folder, **options)
    return read_warc(spark, folder)


def test_round_trip_and_revisits(spark, tmp_path):
    out = run(spark, ROWS, str(tmp_path / "w"), roll_bytes=2000, range_bytes=30_000).collect()
    assert sorted([tuple(r)[:5] for r in out], key=repr) == brute(ROWS)
    html = {(i, (h or "").encode()) for i, _, h, _ in ROWS}
    assert all((r.page_id, bytes(r.payload)) in html for r in out if r.record_type == "response")


def test_short_payloads_stay_responses(spark, tmp_path):
    out = run(spark, ROWS, str(tmp_path / "w"), least_bytes=100).collect()
    assert sorted([tuple(r)[:5] for r in out], key=repr) == brute(ROWS, 100)


def test_same_files_again_and_no_leftovers(spark, tmp_path):
    found = []
    for name in ("a", "b"):
        run(spark, ROWS, str(tmp_path / name), roll_bytes=2000, range_bytes=30_000)
        folder = tmp_path / name
        found.append({f: (folder / f).read_bytes() for f in os.listdir(folder) if f.endswith(".gz")})
        assert not [f for f in os.listdir(folder) if f.startswith(".shard")]
    assert found[0] == found[1] and len(found[0]) > 3


def test_empty_table(spark, tmp_path):
    assert run(spark, [], str(tmp_path / "w")).collect() == []
