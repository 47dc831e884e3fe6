"""Members of archives in parts: against reading them whole, and with little memory."""

import io
import tracemalloc
import zipfile

from pyspark.sql import functions as F

from parchment.sources import files as S


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_streamed_members_are_those_read_whole(spark, tmp_path):
    inner = packed([("deep.txt", b"d" * 5000), ("in/inner.zip", packed([("bottom.bin", b"x"), ("most.zip", packed([("never.txt", b"n")]))])), ("../no.txt", b"u")])
    members = [(f"m{i:03}.txt", bytes([i % 250]) * (i * 37)) for i in range(300)] + [("empty", b""), ("folder/", b""), ("C:/x", b"u"), ("inner.zip", inner), ("bad.zip", b"PK no archive")]
    (tmp_path / "a b.zip").write_bytes(packed(members))
    (tmp_path / "none.zip").write_bytes(b"not an archive")
    (tmp_path / "nothing.zip").write_bytes(packed([]))
    cut = packed([("good.txt", b"g" * 100), ("cut.txt", bytes(range(256)) * 400)])
    at = cut.index(b"cut.txt") + 60
    (tmp_path / "cut.zip").write_bytes(cut[:at] + b"\0" * 40 + cut[at + 40 :])
    found = S.list_material(spark, str(tmp_path), with_content=True)
    parts = S.stream_zip_members(found.select("path"), part_bytes=1000, members_a_task=7)
    rows = parts.collect()
    assert max(len(r.content) for r in rows) <= 1000
    got = {}
    for r in sorted(rows, key=lambda r: r.part):
        got.setdefault((r.archive.rsplit("/", 1)[1], r.member_path, r.level), bytearray()).extend(r.content)
    whole = S.read_zip_members(found.select("path", "content"))
    want = {(r.archive.rsplit("/", 1)[1], r.member_path, r.level): r.content for r in whole.collect()}
    broken = {k for k in got if k[1] == "cut.txt"}
    assert {k: bytes(v) for k, v in got.items() if k not in broken} == {k: bytes(v) for k, v in want.items()}
    assert ("a b.zip", "inner.zip/in/inner.zip/most.zip", 3) in got and not any("never" in k[1] or "no.txt" in k[1] for k in got)
    digests = {r.member_path: (r.length, r.parts) for r in S.member_digests(parts.where(F.col("archive").endswith("a b.zip"))).collect()}
    assert digests["empty"] == (0, 1) and digests["m299.txt"] == (299 * 37, 12)
    assert S.stream_zip_members(found.select("path").where("false")).count() == 0


def test_members_larger_than_memory(tmp_path):
    block = bytes(range(256)) * 4096
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("big.bin", "w") as out:
        for _ in range(300):
            out.write(block)
    tracemalloc.start()
    with S._opened(f"file:{tmp_path}/big.zip") as file:
        size = sum(len(content) for _, _, _, content in S._member_parts(file, "", 1, 3, None, 1 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == 300 * len(block) and peak < 20e6
