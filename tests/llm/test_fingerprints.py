import hashlib
import zlib

from pyspark.sql import functions as F

from probity.llm import fingerprints as module
from probity.llm.fingerprints import edited_text, fingerprint, likeness, neighbour_fingerprints
from probity.llm.queries import QUERIES


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (n, s, t), (m, u, v) = a.split(":"), b.split(":")
    pair = (s, u) if n == m else (s, v) if int(n) == 2 * int(m) else (t, u) if 2 * int(n) == int(m) else None
    if pair is None:
        return 0.0
    longest = max(map(len, pair))
    return 1 - plain_distance(*pair) / longest if longest else 0.0


def test_whole_chain(make, words):
    docs = [(i * 3, " ".join(words(5 + 11 * i, i))) for i in range(30)] + [(200, None), (201, ""), (202, "é🙂" * 9), (203, "a"), (None, "null id"), (204, "aaaa" * 5000), (205, "same"), (205, "same")]
    got = neighbour_fingerprints(make(docs, 4)).collect()
    order = sorted(((d, t or "") for d, t in docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        e, f = edited_text(t, n), fingerprint(t)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, fingerprint(e), round(plain_likeness(f, fingerprint(e)), 9), round(plain_likeness(f, fingerprint(n)), 9)))
    have = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_edits_keep_likeness(spark, words):
    text = " ".join(words(600, 1))
    small = text[:1500] + " an insertion " + text[1500:]
    far = " ".join(words(600, 2))
    df = spark.createDataFrame([(fingerprint(text), fingerprint(small), fingerprint(far))], "a string, b string, c string")
    near, other = df.select(likeness(F.col("a"), F.col("b")), likeness(F.col("a"), F.col("c"))).first()
    assert near > 0.85 and other < 0.4


def test_lone_and_empty(make):
    one = neighbour_fingerprints(make([(1, "abcd efgh")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest()
    assert neighbour_fingerprints(make([(1, "a")]).where("false")).count() == 0


def plain_fingerprint(text):
    """By definition, with loops: rolling sum of seven bytes, boundaries one under multiples of the block size, a character for each chunk."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return "3::"
    rolled = []
    for i in range(len(data)):
        h = sum(int(module._VALUES[data[i - j]]) * int(module._FACTORS[j]) for j in range(min(module.WINDOW, i + 1))) % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        rolled.append(h ^ h >> 13)
    signatures, block = {}, 3
    while True:
        ends = [i + 1 for i, h in enumerate(rolled) if h % block == block - 1]
        chunks = [data[a:b] for a, b in zip([0, *ends], [*ends, len(data)], strict=True) if b > a]
        signatures[block] = (len(ends), "".join(module.ALPHABET[zlib.crc32(c) * 0x9E3779B1 % 2**32 >> 26] for c in chunks))
        if block > 3 and signatures[block // 2][0] < module.MOST:
            return f"{block // 2}:{signatures[block // 2][1]}:{signatures[block][1]}"
        block *= 2


def test_registered_query_against_plain_code(spark, sf_dir):
    """Every row of the smallest table: edited texts, fingerprints and likeness without the module's functions."""
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want = {}
    for k, (doc_id, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        marks = [plain_fingerprint(t) for t in (text, edited, following)]
        want[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], round(plain_likeness(marks[0], marks[1]), 9), round(plain_likeness(marks[0], marks[2]), 9))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in QUERIES["op3_fingerprints"](spark, sf_dir).collect()}
    assert got == want
