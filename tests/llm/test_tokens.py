"""Token counts, token files and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from plumbspark.llm.blocks import mix
from plumbspark.llm.bpe import Encoder, TokenCounter, encoder, forget
from plumbspark.llm.packing import hilbert_key, packed, projection
from plumbspark.llm.token_counts import token_counts
from plumbspark.llm.token_files import CRC32, LISTED, crc_of, decode_block, encode_block, id_type, pack, token_file_round_trip, tokenized, unpack

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))

TEXTS = [
    "", "a  b", "a   b ", "x\n \ny", "foo\n  bar", " lead", "tail ", "it's 'S don't I'LL we're", "<|endoftext|>",
    "a <|endoftext|> b\n <|endoftext|>  c", "aaaaaaaa aaaaaaa", "日本語 テキスト 123 4567", "é É H̱ ́x ΣΑΣ Σ",
    " x y \x1cz \x85", "a" * 3000, "ab" * 2000, "İstanbul ſ K", "word.,., x..y ...", "<|ENDOFTEXT|> <|startoftext|>x",
    "\t\ttab\r\n", "😀 😀😀 a😀b", "!?!?!", "٣ ½ x²", "ÀÉß straße, Ÿ ÿ.",
]


def random_texts(n):
    draw = random.Random(0)
    alphabet = " \n\t  abAB.,'s1é́ß<|  "
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def library(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    texts = TEXTS + random_texts(1500)
    got = TokenCounter(BYTE, memory=50).counts(pa.array(texts))
    assert got.tolist() == [len(x) for x in library(BYTE, texts)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_library(path):
    texts = TEXTS + random_texts(1500)
    ids, ends = Encoder(path, memory=50).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == library(path, texts)


def test_token_counts(docs, odd, rows):
    got = rows(token_counts(docs(odd), BYTE, limit=100), "doc_id", "n_bytes", "n_tokens", "over_limit")
    texts = [t or "" for _, t in odd]
    n = [len(x) for x in library(BYTE, texts)]
    assert got == sorted(((i, len(t.encode()), k, k > 100) for (i, _), t, k in zip(odd, texts, n)), key=repr)
    assert token_counts(docs([]), BYTE, limit=1).count() == 0


def test_variable_length_round_trip():
    draw = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (draw.integers(0, 1 << 32, n) >> draw.integers(0, 32, n)).astype("<u4")
        control, data = pack(ranks)
        assert (unpack(control, data, n) == ranks).all()
        lengths, back = decode_block(encode_block(np.array([n]), ranks))
        assert lengths.tolist() == [n] and (back == ranks).all()
    with pytest.raises(ValueError):
        decode_block(encode_block(np.array([2]), np.array([1, 300]))[:-1])


def test_token_files(docs, odd, real):
    pairs = odd + real[:60]
    got = [tuple(r) for r in crc_of(token_file_round_trip(docs(pairs), WORD, 1)).collect()]
    ids = [x + [1] for x in library(WORD, [t or "" for _, t in pairs])]
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted(
        (i is not None, i or 0, len(x), c) for (i, _), x, c in zip(pairs, ids, crc)
    )
    at = 0
    for doc_id, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    assert token_file_round_trip(docs([]), WORD, 1).count() == 0


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = hilbert_key(points, 3)
    assert sorted(keys) == list(range(512))
    line = points[np.argsort(keys)]
    assert (np.abs(np.diff(line, axis=0)).sum(axis=1) == 1).all()


def test_packing(docs, odd, real):
    pairs = [p for p in odd if p[0] not in (None, 5)] + real[:60]
    pairs = list({i + 1000 * k: t for k, (i, t) in enumerate(pairs)}.items())
    kind = id_type(WORD, 1)
    out = packed(docs(pairs), WORD, 1, 256).toPandas()
    ids = dict(zip((i for i, _ in pairs), (x + [1] for x in library(WORD, [t or "" for _, t in pairs]))))
    for doc_id, part in out.groupby("doc_id"):
        part = part.sort_values("start")
        assert np.concatenate([np.frombuffer(x, kind) for x in part.ids]).tolist() == ids[doc_id]
        assert part.start.tolist() == (part.length.cumsum() - part.length).tolist()
        assert (part.doc_tokens == len(ids[doc_id])).all()
    assert set(out.doc_id) == set(ids)
    for _, sequence in out.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == (sequence.length.cumsum() - sequence.length).tolist()
    sums = out.groupby("sequence_id").length.sum().sort_index()
    assert (sums.iloc[:-1] == 256).all() and sums.iloc[-1] <= 256
    assert packed(docs([]), WORD, 1, 256).count() == 0
    again = packed(docs([(5, "one"), (5, "one"), (None, "one")]), WORD, 1, 256).toPandas()
    assert len(again) == 3 and again.length.sum() == 3 * len(library(WORD, ["one"])[0]) + 3


def test_copies_follow_each_other(docs):
    pairs = [(i, "alpha beta gamma") for i in range(0, 40, 2)] + [(i, f"word{i} other{i * 7} thing") for i in range(1, 40, 2)]
    out = packed(docs(pairs), WORD, 1, 100_000).toPandas().sort_values("offset")
    places = np.flatnonzero(out.doc_id % 2 == 0)
    assert places.max() - places.min() == len(places) - 1


def test_ids_pass_through_one_python_worker(docs, odd, rows, plan):
    """The forms of the ids arise where the ids do, and equal a second pass over the bytes."""
    table, kind = docs(odd + [(50, "word " * 5000)]), id_type(WORD, 1)
    files, made = token_file_round_trip(table, WORD, 1), token_file_round_trip(table, WORD, 1, form=CRC32)
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert rows(made, *columns) == rows(crc_of(files), *columns) and plan(made).count("MapInArrow") == 1
    pieces = packed(table, WORD, 1, 64)
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    made = packed(table, WORD, 1, 64, form=CRC32)
    assert rows(made, *columns) == rows(crc_of(pieces, kind), *columns) and plan(made).count("MapInArrow") == 1
    made = packed(table, WORD, 1, 64, form=LISTED)
    want = {(r.sequence_id, r.offset): np.frombuffer(r.ids, kind).tolist() for r in pieces.collect()}
    assert {(r.sequence_id, r.offset): r.ids for r in made.collect()} == want
    assert plan(tokenized(table, WORD, 1, point=projection())).count("MapInArrow") == 1
    assert packed(docs([]), WORD, 1, form=LISTED).count() == 0 and token_file_round_trip(docs([]), WORD, 1, form=CRC32).count() == 0


def test_registered_queries_read_ids_in_one_pass(spark, sf, plan):
    import corpus_pipeline
    from plumbspark.llm.queries import QUERIES

    for name in ("op5_token_files", "op7_hilbert_packing"):
        assert plan(QUERIES[name](spark, sf)).count("MapInArrow") == 1
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert plan(corpus_pipeline.packing(spark, table, sf)).count("MapInArrow") == 1


def test_projected_points_are_means_of_signs():
    ids, starts = np.array([5, 9, 9, 70000, 1, 1], np.uint32), np.array([0, 4, 5])
    got = projection(3)(ids, starts)
    bits = mix(ids.astype(np.uint64) + np.uint64(0x5EED))
    for k in range(3):
        sign = 1.0 - 2.0 * ((bits >> np.uint64(k)) & np.uint64(1)).astype(float)
        assert got[:, k].tolist() == [sign[:4].mean(), sign[4], sign[5]]


def test_encoders_are_forgotten():
    encoder(WORD).encode(pa.array(["some words"]))
    assert encoder.cache_info().currsize
    forget()
    assert not encoder.cache_info().currsize


def test_packing_tables_are_held_tightly(docs, odd, tmp_path, monkeypatch):
    """Texts and ids between the jobs of the pipeline take no more room than they need."""
    from plumbspark.llm import storage

    monkeypatch.setattr(storage, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    packed(docs(odd), WORD, 1, 64)
    for name in ("packing-points", "packing-line"):
        files = [p.name for p in (tmp_path / name).glob("part-*")]
        assert files and all(".zstd." in f for f in files)
