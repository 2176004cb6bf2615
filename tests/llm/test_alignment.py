import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from probity.llm.alignment import align, align_tokenizers, links

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def letters():
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def brute(docs):
    """Token by token, with pairs of all tokens whose byte ranges lie between the same two shared ends."""
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(A)
    a_model.encode_special_tokens = True
    b_model, back = sentencepiece.SentencePieceProcessor(model_file=B), letters()
    found = []
    for _, text in docs:
        want = (" " + (text or "")).encode()
        a = a_model.encode(want.decode(), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        tokens_a = [bytes(back[c] for c in a_model.id_to_token(i)) for i in a]
        pieces = [b_model.id_to_piece(i) for i in b]
        tokens_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        if not text or b"".join(tokens_a) != want or b"".join(tokens_b) != want:
            found.append((0, 0, []))
            continue
        groups, x, y, end_a, end_b = [([], [])], 0, 0, 0, 0
        while x < len(a) or y < len(b):
            if end_a <= end_b:
                groups[-1][0].append(a[x])
                end_a += len(tokens_a[x])
                x += 1
            else:
                groups[-1][1].append(b[y])
                end_b += len(tokens_b[y])
                y += 1
            if end_a == end_b:
                groups.append(([], []))
        found.append((len(a), len(b), groups[:-1]))
    pairs = [[(i, j) for g in groups for i in g[0] for j in g[1]] for _, _, groups in found]
    count = Counter(p for some in pairs for p in set(some))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    rows = []
    for (doc_id, _), (n_a, n_b, groups), some in zip(docs, found, pairs, strict=True):
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        rows.append((doc_id, n_a, n_b, len(groups), len(some), sum(count[p] == best[p[0]] for p in some), sum(count[p] for p in some), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(rows, key=repr)


def run(df, **kw):
    return sorted((tuple(r) for r in align_tokenizers(df, A, B, **kw).collect()), key=repr)


ODD = ["", None, " ", "  ", "  a  b ", "foo ", " foo", "a▁b", "<s> </s> <0x41> <unk>", "naïve x\n\n y\t z", "<|endoftext|> x <|endoftext|>", "é", "日本語 テスト", "\U0001f600 \U0001f600\U0001f600", "　a", "x" * 3000, "\r\n", "\x01\x7f", "I'll we've  it's", "1234567890 3.14"]


def test_equals_brute_force(make, words, spark, sf_dir):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(words(60, i))) for i in range(20)] + [(100, " ".join(words(60, 0))), (None, "a word")]
    docs += [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    assert run(make(docs)) == brute(docs)
    # Units of one batch each give the same as one unit.
    assert run(make(docs, 5), unit_bytes=1) == brute(docs)


def test_very_long_text(make, words):
    docs = [(1, " ".join(words(150_000, 3))), (2, " ".join(words(40, 3)))]
    assert run(make(docs)) == brute(docs)


def test_empty_table(make):
    assert run(make([(1, "a")]).where("false")) == []
    assert run(make([(1, None)])) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_groups_and_products():
    """Two tokens against three in one group are six links, of which only four overlap."""
    group_a, group_b, n = align(np.array([2, 5, 9]), np.array([1, 3, 5, 9]))
    assert (group_a.tolist(), group_b.tolist(), n) == ([0, 0, 1], [0, 0, 0, 1], 2)
    a, b = links(group_a, group_b, n)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 3)]
