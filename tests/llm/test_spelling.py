"""Spelling variants against a plain version over all pairs of words that can be near."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from plumbspark.llm import spelling as S
from plumbspark.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def typed(rows):
    counts = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return counts


def variants(rows, min_chars=7, min_count=2, times=10):
    words = {w: n for w, n in typed(rows).items() if len(w) >= min_chars and n >= min_count}
    gaps = defaultdict(set)  # words of one length that agree but for one place
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            gaps[i, w[:i], w[i + 1 :]].add(w)
            cut = w[:i] + w[i + 1 :]
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def taken(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_whole_query_equals_the_plain_version(spark, sf, real):
    out = QUERIES["op11_spelling_variants"](spark, sf)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    want = variants(real)
    assert taken(out) == want and any(r[1] for r in want)


PLANTED = [
    (1, "straße Größenwahn " * 40 + "grössenwahn grössenwahn"),
    (2, "bookkeeper " * 30 + "bokkeeper bokkeeper " + "bookeeper bookeeper bookkeeperx bookkeeperx"),
    (3, "aaaaaaaa " * 200 + "aaaaaaa " * 20 + "aaaaaab aaaaaab"),  # a chain of forms
    (4, "tieword " * 2 + "tiewora " * 30 + "tieworb " * 30),  # equal counts: the first in order
    (5, "exactly1 exactly2 won't don't x² ×÷×÷×÷× ×÷×÷×÷×"),
    (6, "z" * 3000 + " " + "z" * 3000 + " " + "z" * 2999 + "y " + "z" * 2999 + "y"),
    (7, "q" * 70 + " " + "q" * 70 + " " + "q" * 71 + " " + "q" * 71),
]


def test_planted_words(docs, odd):
    rows = PLANTED + odd
    want = variants(rows)
    got = taken(S.spelling_variants(S.vocabulary_of(S.typed_words(docs(rows)))))
    assert got == want
    roots = {r[0]: r[2] for r in got}
    assert roots["aaaaaab"] == "aaaaaaaa" and roots["tieword"] == "tiewora"
    assert roots["bokkeeper"] == "bookkeeper" and roots["bookkeeperx"] == "bookkeeper"


def test_long_runs_take_their_checksum_alone(docs):
    rows = [(i, f"{'w' * n} {'w' * n}") for i in range(40) for n in (255, 256, 257, 300)]
    counts = Counter()
    for r in S.typed_words(docs(rows)).collect():
        counts[r.word] += r.n
    assert counts == typed(rows)


def test_many_passes_and_parts_give_the_same(spark, real, monkeypatch, rows):
    from pyspark.sql import functions as F

    words = sorted((w, n) for w, n in typed(real).items() if len(w) >= 7 and n >= 2)
    vocabulary = spark.createDataFrame(words, "word string, n long").withColumn("n", F.col("n")).repartition(4)
    whole = rows(S.near_words(vocabulary))
    monkeypatch.setattr(S, "KEYS_PER_PART", 100)
    assert rows(S.near_words(vocabulary, pass_bytes=2000)) == whole


def test_an_empty_table_has_no_words(spark, docs):
    assert S.spelling_variants(S.vocabulary_of(S.typed_words(docs([])))).collect() == []


@pytest.mark.parametrize("text", ["", None, "short words only", "1234567 7654321"])
def test_texts_without_words(docs, text):
    assert S.spelling_variants(S.vocabulary_of(S.typed_words(docs([(1, text), (2, text)])))).collect() == []
