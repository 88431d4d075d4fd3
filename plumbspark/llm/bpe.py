"""Byte-pair vocabularies read from a tokenizer file: ranks as arrays, and a library encoder with a memory."""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The characters of Unicode's White_Space, and the byte-level pre-token pattern of the vocabulary.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_W = regex.sub(r"\\x\{(\w+)\}", lambda m: "\\u" + m[1].rjust(4, "0"), WHITE)
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+"
_SPLIT = regex.compile(PRE_TOKEN)
#: A space with white space before it and after it (or the end): a cut there could part one run of white space.
_UNSAFE = rf"[{WHITE}] (?:[{WHITE}]|\z)"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for
    themselves, the others by the characters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    out = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [out[b] for b in range(256)]


_NONE = np.int64(2**62)


class RankTable:
    """Merge ranks as sorted pair keys; merges whole batches of pre-tokens rank by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = np.int64(max(vocab.values()) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], np.int64)
        # a pair that is listed twice holds the rank of its last place
        last = dict(zip(keys.tolist(), range(len(keys))))
        self.keys = np.array(sorted(last), np.int64)
        self.rank = np.array([last[k] for k in self.keys.tolist()], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        """Symbols of each pre-token that survive all merges. Every round applies, in all pre-tokens at
        once, the pair of lowest rank of each."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pre_tokens]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        result, seq = lengths.copy(), np.arange(len(raw))
        live = lengths > 1
        symbol, lengths, seq = symbol[np.repeat(live, lengths)], lengths[live], seq[live]
        rank = self._all_ranks(symbol, lengths)
        while len(seq):
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            if done.any():
                result[seq[done]] = lengths[done]
                keep = np.repeat(~done, lengths)
                symbol, rank = symbol[keep], rank[keep]
                lengths, seq, best = lengths[~done], seq[~done], best[~done]
                if not len(seq):
                    break
            of = np.repeat(np.arange(len(seq)), lengths)
            hit = rank == best[of]
            # in a run of overlapping hits (aaa) every second one merges, from the left
            at = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit, -1, at))
            hit &= (at - run) % 2 == 1
            where = np.flatnonzero(hit)
            symbol[where] = self.made[best[of[where]]]
            keep = np.ones(len(symbol), bool)
            keep[where + 1] = False
            place = np.cumsum(keep) - 1
            symbol, rank, of = symbol[keep], rank[keep], of[keep]
            lengths = np.bincount(of, minlength=len(seq))
            where = place[where]
            touched = np.zeros(len(symbol), bool)
            touched[where] = touched[(where - 1)[where > 0]] = True
            near = np.flatnonzero(touched)
            rank[near] = _NONE
            near = near[near + 1 < len(symbol)]
            near = near[of[near] == of[near + 1]]
            rank[near] = self.ranks(symbol[near], symbol[near + 1])
        return result

    def _all_ranks(self, symbol: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        rank = np.full(len(symbol), _NONE)
        if len(symbol) > 1:
            inner = np.ones(len(symbol), bool)
            inner[np.cumsum(lengths) - 1] = False
            at = np.flatnonzero(inner)
            rank[at] = self.ranks(symbol[at], symbol[at + 1])
        return rank


class TokenCounter:
    """Token counts of whole texts. Texts are cut before spaces where no pre-token can cross; a piece's
    count is remembered, up to ``memory`` pieces."""

    def __init__(self, path: str, memory: int = 400_000):
        self.table = RankTable(path)
        self.memory = memory
        self.known: dict[str, int] = {}

    def pre_tokens(self, piece: str) -> list[str]:
        return _SPLIT.findall(piece)

    def _learn(self, pieces: list[str]) -> None:
        split = [_SPLIT.findall(p) for p in pieces]
        coded = pa.array([t for s in split for t in s], pa.large_string()).dictionary_encode()
        counts = self.table.count(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        sums = np.concatenate([[0], np.cumsum(counts)])
        self.known.update(zip(pieces, (sums[ends] - sums[np.concatenate([[0], ends[:-1]])]).tolist()))

    def of_pieces(self, pieces: list[str]) -> np.ndarray:
        get = self.known.get
        found = [get(p, -1) for p in pieces]
        if new := [p for p, n in zip(pieces, found) if n < 0]:
            if len(self.known) + len(new) > self.memory:
                self.known.clear()
                new = pieces
            self._learn(new)
            found = [self.known[p] for p in pieces]
        return np.array(found, np.int64)

    def whole(self, text: str) -> int:
        """A text with special strings or unsafe white space, without any cut but at special strings."""
        special, parts = self.table.special, [text]
        n = 0
        if special:
            parts = regex.split("|".join(map(regex.escape, sorted(special, key=len, reverse=True))), text)
            n = len(parts) - 1
        return n + int(self.table.count([t for p in parts for t in _SPLIT.findall(p)]).sum())

    def counts(self, texts: pa.Array) -> np.ndarray:
        odd = pc.match_substring_regex(texts, _UNSAFE)
        for s in self.table.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        starts, lengths = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        first = np.zeros(len(flat), bool)
        first[starts - lists.offsets.to_numpy()[0]] = True
        later = flat.filter(pa.array(~first)).dictionary_encode()
        count = np.zeros(len(flat), np.int64)
        count[~first] = self.of_pieces([" " + p for p in later.dictionary.to_pylist()])[later.indices.to_numpy()]
        heads = flat.filter(pa.array(first)).dictionary_encode()
        count[first] = self.of_pieces(heads.dictionary.to_pylist())[heads.indices.to_numpy()]
        row = np.repeat(np.arange(len(texts)), lengths)
        out = np.bincount(row, weights=count, minlength=len(texts)).astype(np.int64)
        for i in np.flatnonzero(odd):
            out[i] = self.whole(texts[i].as_py())
        return out


class Encoder:
    """Ids by the tokenizers library. Where the vocabulary's pre-tokenizer drops all white space, texts
    are cut at ASCII white space and the ids of a chunk are remembered: up to ``words`` chunks as they stand, in flat
    arrays, and ``memory`` lower-cased ones without their tails; else whole texts go to the library."""

    def __init__(self, path: str, memory: int = 250_000, words: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = _drops_white_space(spec)
        self.width = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.memory = memory
        self.known: dict[str, bytes] = {}
        self.words = words
        self._forget()
        symbols = byte_symbols()
        self._symbols = {c: "".join(symbols[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

    def _forget(self) -> None:
        self._seen, self._ids, self._ends = pa.array([], pa.string()), np.empty(0, self.width), np.zeros(1, np.int64)

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.width is np.uint16 else "I", ids).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a in range(0, len(texts), 2048):  # an encoding holds far more than its ids
            part = self.library.encode_batch_fast(texts[a : a + 2048], add_special_tokens=False)
            out += [self._bytes(e.ids) for e in part]
        return out

    def _lookup(self, keys: list[str], make) -> list[bytes]:
        get = self.known.get
        found = [get(k) for k in keys]
        if new := [k for k, v in zip(keys, found) if v is None]:
            if len(self.known) + len(new) > self.memory:
                self.known.clear()
                new = keys
            self.known.update(zip(new, make(new)))
            found = [self.known[k] for k in keys]
        return found

    def _plain(self, words: list[str]) -> list[bytes]:
        """Lower-case letters of Latin-1, which normalization leaves alone: one pre-token, so the
        library's model sees the word itself in byte symbols."""
        tokenize, symbols = self.library.model.tokenize, self._symbols
        return [self._bytes([t.id for t in tokenize(w if w.isascii() else w.translate(symbols))]) for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts."""
        from plumbspark.llm.blocks import Words, ragged_take

        if not self.by_word:
            parts = self._whole(texts.to_pylist())
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.width().itemsize
            return np.frombuffer(b"".join(parts), self.width), np.concatenate([[0], np.cumsum(sizes)])
        words = Words(texts)
        at = self._places(words.unique)
        out, ends_at = ragged_take(self._ids, self._ends, at[words.code])
        return out, ends_at[words.start]

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Where the flat arrays have the ids of each of the different ``chunks``; only new ones are encoded."""
        at = pc.index_in(chunks, value_set=self._seen)
        if at.null_count and len(self._seen) + at.null_count > self.words:
            self._forget()
            at = pa.nulls(len(chunks), pa.int32())
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = chunks.take(pa.array(fresh))
            ids, ends = self._chunk_ids(new)
            at[fresh] = len(self._seen) + np.arange(len(fresh))
            self._seen = pa.concat_arrays([self._seen, new])
            self._ids = np.concatenate([self._ids, ids])
            self._ends = np.concatenate([self._ends, self._ends[-1] + ends[1:]])
        return at

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and the chunks' offsets. A chunk of plain letters is a head and perhaps a
        tail of points and commas; any other is a head."""
        from plumbspark.llm.blocks import ragged_take

        core = pc.ascii_rtrim(chunks, ".,")
        plain = pc.match_substring_regex(core, "^[A-Za-zÀ-ÖØ-öø-ÿ]+$").to_numpy(zero_copy_only=False)
        chosen = pa.array(plain)
        full, core = chunks.filter(chosen), core.filter(chosen)
        heads = pc.utf8_lower(core).dictionary_encode()
        own, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        short = pc.binary_length(core).to_numpy(zero_copy_only=False)
        tailed = np.flatnonzero(pc.binary_length(full).to_numpy(zero_copy_only=False) > short)
        letters = pc.utf8_length(core.take(pa.array(tailed))).to_pylist()
        tails = pa.array([w[n:] for w, n in zip(full.take(pa.array(tailed)).to_pylist(), letters)], pa.string()).dictionary_encode()
        made = [b"", *self._lookup(heads.dictionary.to_pylist(), self._plain)]
        first_rest = len(made)
        made += self._lookup(chunks.filter(pa.array(~plain)).to_pylist(), self._whole)
        first_tail = len(made)
        made += self._whole(tails.dictionary.to_pylist())
        pieces = np.zeros((len(chunks), 2), np.int64)  # 0 is the empty piece
        pieces[own, 0] = 1 + heads.indices.to_numpy(zero_copy_only=False)
        pieces[own[tailed], 1] = first_tail + tails.indices.to_numpy(zero_copy_only=False)
        pieces[rest, 0] = first_rest + np.arange(len(rest))
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // self.width().itemsize
        flat = np.frombuffer(b"".join(made), self.width)
        ids, ends = ragged_take(flat, np.concatenate([[0], np.cumsum(sizes)]), pieces.ravel())
        return ids, ends[::2]


def _drops_white_space(spec: dict) -> bool:
    """The pre-tokenizer keeps only matches of a pattern that never holds white space, the normalizer
    changes no character in view of those beyond white space, and no special string holds white space."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex")
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and normal == ["NFC", "Replace", "Lowercase"]
        and spec["model"].get("end_of_word_suffix") is not None
        and not any(regex.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    )


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def forget() -> None:
    """Frees what this worker's encoders hold: it outlives the tasks that encode, and another stage's need the room."""
    from plumbspark.llm.blocks import release

    if encoder.cache_info().currsize or counter.cache_info().currsize:
        encoder.cache_clear()
        counter.cache_clear()
        release()
