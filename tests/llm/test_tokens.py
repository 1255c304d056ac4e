"""BPE by prefix tables, length histogram, packing."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe, packing, queries, token_counts
from sparkloom.llm.queries import PATTERN, RANKS

TEXTS = [None, "", " ", "a", "  two  words\n\n ", "don't <|endoftext|> 12345 !?", "naïve 漢字 😀‍ 'll", "x" * 5000, " " * 300 + "end", "é" * 700, "The quick brown fox.\n" * 400]


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return bpe.PrefixEncoder(bpe.parse_ranks(f.read()))


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        return bpe.fast_encoder(f.read(), PATTERN)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def encode(encoder, text):
    return bpe.EncodedText(encoder, PATTERN, text).ids()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_and_round_trip(encoder, reference, text):
    ids = encode(encoder, text)
    assert ids == reference.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_three_encoders_agree(encoder, reference, tokenizer):
    for text in filter(None, TEXTS):
        assert encode(encoder, text) == reference.encode_ordinary(text) == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60), st.binary(max_size=8))
def test_bytes_appended_and_edited(encoder, s, i, j, new):
    i, j = sorted((min(i, len(s)), min(j, len(s))))
    g = bpe.GrowingBytes(encoder, s)
    g.edit(i, j, new)
    g.append(b"ing")
    whole = s[:i] + new + s[j:] + b"ing"
    assert g.ids() == encoder.merge(whole)
    assert [g.ids(k) for k in range(len(whole) + 1)] == [encoder.merge(whole[:k]) for k in range(len(whole) + 1)]


def test_edit_recomputes_only_near(encoder, reference):
    text = "the quick brown fox jumps over the lazy dog. " * 200
    e = bpe.EncodedText(encoder, PATTERN, text)
    e.edit(4000, 4003, "slow ")
    assert e.ids() == reference.encode_ordinary(text[:4000] + "slow " + text[4003:])
    assert e.recomputed < 20
    g = bpe.GrowingBytes(encoder, b"abcdefgh" * 500)
    g.edit(1000, 1001, b"zz")
    assert g.recomputed < 600 and g.ids() == bpe.GrowingBytes(encoder, g.s).ids()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n'é1", max_size=40), st.integers(0, 40), st.integers(0, 40), st.text(alphabet="ab 's1", max_size=5))
def test_text_edit(encoder, reference, text, i, j, new):
    i, j = sorted((min(i, len(text)), min(j, len(text))))
    e = bpe.EncodedText(encoder, PATTERN, text)
    e.edit(i, j, new)
    assert e.ids() == reference.encode_ordinary(text[:i] + new + text[j:])


def frame(spark, texts=TEXTS):
    # extra columns whose names the operators use themselves
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate([*texts, *texts[-1:]])], "id long, body string, text string, n_tokens int")


def test_encode_documents(spark, reference):
    got = {r["doc_id"]: r for r in bpe.encode_documents(frame(spark), "id", "body", RANKS, PATTERN).collect()}
    assert len(got) == len(TEXTS) + 1
    for k, t in enumerate([*TEXTS, TEXTS[-1]]):
        ids = reference.encode_ordinary(t or "")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.encode_documents(frame(spark).limit(0), "id", "body", RANKS, PATTERN).count() == 0


def test_piece_cache_turnover(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CACHE", 20)
    pieces = bpe._Pieces(encoder)
    for lo in range(0, 60, 7):
        words = {f" w{k}" for k in range(lo, lo + 7)}
        pieces.learn(words)
        assert all(pieces[w][1] == w.encode() for w in words)


def test_histogram(spark, reference):
    rows = token_counts.length_histogram(token_counts.encoded_lengths(frame(spark), "body", RANKS, PATTERN), bucket=3).collect()
    lengths = [len(reference.encode_ordinary(t or "")) for t in [*TEXTS, TEXTS[-1]]]
    assert Counter(lengths) == {r["n_tokens"]: r["n_docs"] for r in rows}
    for r in rows:
        n = r["n_tokens"]
        assert r["docs_ge"] == sum(x >= n for x in lengths) and r["tokens_ge"] == sum(x for x in lengths if x >= n)
        assert r["tokens_truncated"] == sum(min(x, n) for x in lengths) and r["tokens"] == n * r["n_docs"]


def test_histogram_answers(spark):
    hist = token_counts.length_histogram(spark.createDataFrame([(1, 2), (5, 1), (5, 1), (900, 1)], "n_tokens long, n_docs long"))
    assert tuple(token_counts.at_limit(hist, 4).first()) == (3, 14, 898)
    assert [token_counts.length_quantile(hist, q).first()[0] for q in (0.1, 0.4, 0.5, 0.8, 0.9, 1.0)] == [1, 1, 5, 5, 900, 900]
    empty = token_counts.length_histogram(token_counts.encoded_lengths(frame(spark).limit(0), "body", RANKS, PATTERN))
    assert empty.count() == 0 and token_counts.length_quantile(empty, 0.5).first()[0] is None


def check_packing(rows, want, size=2048):
    """Gapless sequences, every id once, no padding but at powers of two."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        docs[r["doc_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == size or at & (at - 1) == 0
    assert set(docs) == set(want)
    for doc, pieces in docs.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            ids = np.array(want[doc][at : at + p["length"]], "<u4")
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(want[doc]), zlib.crc32(ids.tobytes()))
            at += p["length"]
        assert at == len(want[doc])


def test_pack_documents(spark, tokenizer):
    rng = random.Random(3)
    texts = [*TEXTS, *[" ".join(rng.choice(["alpha", "be", "gamma ray"]) for _ in range(rng.randint(0, 2500))) for _ in range(150)]]
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "id long, body string, offset int").repartition(3, "id")
    rows = packing.pack_documents(df, "id", "body", RANKS, PATTERN).collect()
    check_packing(rows, {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)})
    assert packing.pack_documents(df.limit(0), "id", "body", RANKS, PATTERN).count() == 0


def test_added_tokens_as_the_tokenizer_has_them(spark, tmp_path):
    loaded = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [*TEXTS, f"a{end}b", end, end * 3, f" {end} ", f"a  {end}\n\n b{end[:-1]} {end}>", f"<|{end}", end.upper()]
    want = [loaded.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[len(TEXTS)] == [64, 50256, 65]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check_packing(queries.op10_packing(spark, str(tmp_path)).collect(), {k: [*ids, 1] for k, ids in enumerate(want)})
    assert {r["n_tokens"]: r["n_docs"] for r in queries.op6_token_counts(spark, str(tmp_path)).collect()} == Counter(map(len, want))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=80), st.integers(1, 6))
def test_sum_of_squares(lengths, most):
    packer, placed = packing.SumOfSquares(32, most), []
    for k, n in enumerate(lengths):
        placed += packer.add(k, np.arange(n, dtype=np.uint32))
        assert len(packer.held) <= most and int(packer.counts.sum()) == len(packer.held)
    placed += packer.finish()
    rows = [{"doc_id": d, "start": s, "length": len(i), "ids_crc32": zlib.crc32(i.astype("<u4").tobytes()), "doc_tokens": n, "sequence_id": w, "offset": at} for w, at, (d, s, i, n) in placed]
    check_packing(rows, {k: list(range(n)) for k, n in enumerate(lengths)}, 32)


def test_level_minimises_squares():
    packer = packing.SumOfSquares(10)
    rng = random.Random(1)
    for k in range(300):
        s, c = rng.randint(1, 9), packer.counts.copy()
        options = {}
        for h in [0, *[h for h in range(1, 10) if c[h] and h + s <= 10]]:
            after = c.copy()
            if h:
                after[h] -= 1
            if h + s < 10:
                after[h + s] += 1
            options[h] = int((after**2).sum())
        list(packer.add(k, np.zeros(s, np.uint32)))
        assert int((packer.counts**2).sum()) == min(options.values())


def test_what_is_open_at_the_end_is_placed_by_the_rule():
    """Many small splits: of the pieces under a window's size few are moved at the end, fewer are cut, and a cut closes a window."""
    rng = random.Random(4)
    kept = moved = cut = 0
    for _ in range(32):
        packer, at_end = packing.SumOfSquares(), {}
        done = [p for k in range(320) for p in packer.add(k, np.zeros(max(1, min(20_000, int(rng.lognormvariate(6, 1)))), np.uint32))]
        for window, pieces in packer.held.items():
            at_end |= {(p[0], p[1]): window for p in pieces}
        kept += sum(len(p[2][2]) < 2048 for p in done)
        last = list(packer.finish())
        final = {(p[0], p[1]): (w, len(p[2])) for w, _, p in last}
        stay = sum(final.get(k, (None,))[0] == w for k, w in at_end.items())
        kept, moved, cut = kept + stay, moved + len(at_end) - stay, cut + len(last) - len(at_end)
        fill = Counter()
        for w, _, p in [*done, *last]:
            fill[w] += len(p[2])
        short = sorted(n for n in fill.values() if n < 2048)
        assert len(short) <= 11 and all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)
    assert moved < 0.05 * kept and cut < 0.3 * kept


def test_queries_over_whole_tables(spark, sf_dir, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op9_bpe(spark, sf_dir).collect()} == {k: len(reference.encode_ordinary(t)) for k, t in docs.items()}
    assert sum(r["n_docs"] for r in queries.op6_token_counts(spark, sf_dir).collect()) == len(docs)
    check_packing(queries.op10_packing(spark, sf_dir).collect(), {k: [*reference.encode_ordinary(t), 1] for k, t in docs.items()})
