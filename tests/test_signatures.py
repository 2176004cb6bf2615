"""Signatures by tables of points against plain multiplication."""

import pandas as pd
from pyspark.sql import functions as F

from probity.functions import ed25519
from probity.plans import selftest


def test_tables_give_the_plain_products():
    for n in (0, 1, 15, 16, ed25519.ORDER - 1, 2**255 - 19, 2**256 - 1):
        for p in (ed25519._BASE, ed25519._times(7, ed25519._BASE)):
            assert ed25519._same(ed25519._by_table(n, p), ed25519._times(n, p))


def test_known_signature_and_few_additions(monkeypatch):
    """The first vector of RFC 8032; then a signature by a known key takes an addition a digit, not two a bit."""
    key = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public, signature = ed25519.public_key(key), ed25519.sign(key, b"")
    assert public.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert signature.hex() == "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert ed25519.verify(public, b"", signature, True) and not ed25519.verify(public, b"x", signature, True)
    calls, add = [], ed25519._add
    monkeypatch.setattr(ed25519, "_add", lambda p, q: (calls.append(1), add(p, q))[1])
    assert ed25519.verify(public, b"", signature, True) and ed25519.sign(key, b"") == signature
    assert len(calls) <= 200


def test_columns_with_gaps():
    key = bytes(range(32))
    public, message = ed25519.public_key(key).hex(), "00ff"
    good = ed25519.sign(key, bytes.fromhex(message)).hex()
    rows = [(public, message, good)] * 9 + [(None, message, good), (public, None, good), (public, "zz", good), (public, "00fe", good)]
    got = ed25519.signature_ok.func(*(pd.Series(c, dtype=object) for c in zip(*rows, strict=True)))
    assert got.tolist() == [True] * 9 + [False] * 4


def test_signatures_are_dealt_to_tasks(spark, sf_dir, tmp_path, monkeypatch):
    """Manifests are small, yet they don't all land in one task."""
    spark.range(1, 41).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(selftest, "SIGNED_ROWS", 5)
    got = selftest.manifest_signatures(spark, str(tmp_path)).withColumn("part", F.spark_partition_id()).collect()
    assert len(got) == 40 and len({r.part for r in got}) > 4
    assert {r.model for r in got if not r.ok} == {f"model-{i}" for i in range(1, 41) if i % 7 == 3 or i % 11 == 5}
