"""Evaluation passages inside a corpus: CGK embedding, bit-sampling LSH over windows, exact edit check.

Words are compared after folding letter case, accents, ligatures, punctuation, divided words and set-off
interruptions. CGK random-walk embedding: a window of words is read by a pointer that moves on or stays by a
random bit of (step, word); the sequence read has small Hamming distance whenever the windows have small edit
distance. A few sampled steps form one LSH signature; ``REPEATS`` independent walks reach the target recall.
Windows have ``WINDOW`` words, every position in items, every ``STRIDE``-th in documents: of a shortest
passage (20 words, two differences) several windows hold at most one difference. Documents whose signature
meets an item's are then checked exactly, over the whole passage, by edit alignment of words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE, REPEATS, SAMPLES, STEPS = 12, 2, 8, 6, 22
MIN_WORDS, ONE_IN, SEED = 20, 10, 4
ITEMS_AT_ONCE = 2000
_BITMAP = 22

_SET_OFF = re.compile(r"(?<!\S)\((?:[^()\[\]]|\[[^\[\]]*\]|\([^()]*\))*\)|\[[^\[\]]*\]|(?<=\s)[—–]\s[^—–]{1,80}[.!?]\s[—–](?=\s)")
_DIVIDED = re.compile(r"(\w)[-‐\xad]\s*\n\s*(\w)")
_LETTERS = (("ß", "ss"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ı", "i"), ("æ", "a"), ("œ", "o"), ("—", " "), ("–", " "), ("…", " "))
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0670]")
_FOREIGN = re.compile("[\u0100-\u02ff\u0370-\u1fff\u2c00-\ufaff\ufb1d-\ufdff\ufe70-\uffdc\U00010000-\U0010ffff]")  # letters beyond the Latin ones that fold to ASCII
_OTHER_SIGNS = re.compile(r"[^\w\s]|_")
_IDEOGRAPHS = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
_KEEP = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"/\t\n\r\v\f" else c for c in range(256))
_SIGNS = bytes(c for c in range(256) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c in b" /\t\n\r\v\f"))


def words_of(text: str | None, scans: bool = True) -> list[str]:
    """Folded words of any script; interruptions in brackets and signs are left out, ideographs are words of their own.
    ``scans``: letters that scanning confuses (rn and m, the spellings of umlauts) are made one."""
    if not text:
        return []
    t = _DIVIDED.sub(r"\1\2", text) if "\n" in text else text
    t = _SET_OFF.sub(" ", t)
    if not t.isascii():
        t = t.lower()
        for old, new in _LETTERS:
            if old in t:
                t = t.replace(old, new)
        t = unicodedata.normalize("NFKD", t)
    if t.isascii() or not _FOREIGN.search(t):
        t = t.encode("ascii", "ignore").translate(_KEEP, _SIGNS).decode()
    else:
        t = _MARKS.sub("", t.casefold()).replace("/", " ")
        t = _IDEOGRAPHS.sub(r" \g<0> ", _OTHER_SIGNS.sub("", t))
    if scans:
        t = t.replace("ae", "a").replace("oe", "o").replace("ue", "u").replace("rn", "m")
    return t.split()


def walk_tables(repeats: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps (repeats, SAMPLES), one from each part of the walk, and a seed per repetition."""
    rng = np.random.default_rng(seed)
    edges = np.linspace(0, STEPS, SAMPLES + 1).astype(int)
    picks = np.stack([[rng.integers(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)] for _ in range(repeats)])
    return picks, rng.integers(1, 2**62, repeats)


def signatures(codes: np.ndarray, mixed: np.ndarray, starts: np.ndarray, picks: np.ndarray, seed: int) -> np.ndarray:
    """LSH signature of the windows at ``starts``. ``mixed`` has a 64-bit hash per word code."""
    pos = starts.astype(np.int64)
    last = len(codes) - 1
    sig = np.full(len(starts), seed, np.uint64)
    bits = mixed * np.uint64(int(seed) | 1)
    bits ^= bits >> np.uint64(29)
    sampled = set(picks.tolist())
    for step in range(int(picks.max()) + 1):
        w = codes[pos]
        if step in sampled:
            sig = (sig ^ mixed[w]) * np.uint64(0x9E3779B97F4A7C15)
            sig ^= sig >> np.uint64(32)
        pos = pos + ((bits >> np.uint64(step + 1)) & np.uint64(1)).astype(np.int8)[w]
        np.minimum(pos, last, out=pos)
    return sig


def _hash_words(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


class ItemIndex:
    """Signatures of all windows of some items, small enough to be shipped with the task."""

    def __init__(self, items: list[tuple[int, str]], repeats: int, scans: bool = True):
        self.scans = scans
        self.ids, self.words, self.vocab = [], [], {"": 0}
        for item, text in items:
            w = words_of(text, scans)
            if len(w) >= MIN_WORDS:
                self.ids.append(item)
                self.words.append(w)
                for x in w:
                    self.vocab.setdefault(x, len(self.vocab))
        self.mixed = _hash_words(list(self.vocab))
        self.codes = [np.array([self.vocab[x] for x in w], np.int32) for w in self.words]
        self.picks, self.seeds = walk_tables(repeats)
        flat = np.concatenate([np.r_[c, np.zeros(1, np.int32)] for c in self.codes]) if self.codes else np.zeros(1, np.int32)
        owner = np.concatenate([np.full(len(c) + 1, k) for k, c in enumerate(self.codes)]) if self.codes else np.zeros(1, int)
        offset = np.concatenate([np.arange(len(c) + 1) for c in self.codes]) if self.codes else np.zeros(1, int)
        keep = np.concatenate([np.arange(len(c) + 1) <= len(c) - WINDOW for c in self.codes]) if self.codes else np.zeros(1, bool)
        starts = np.flatnonzero(keep)
        self.tables = []
        for picks, seed in zip(self.picks, self.seeds, strict=True):
            sig = signatures(flat, self.mixed, starts, picks, seed)
            order = np.argsort(sig, kind="stable")
            bitmap = np.zeros(1 << _BITMAP, bool)
            bitmap[(sig >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True
            self.tables.append((sig[order], owner[starts][order], bitmap))
        self.offset = offset
        self.grams: list[dict[tuple, list[int]]] = []
        for w in self.words:
            grams: dict[tuple, list[int]] = {}
            for i, g in enumerate(zip(*[w[k:] for k in range(SEED)], strict=False)):
                grams.setdefault(g, []).append(i)
            self.grams.append(grams)

    def candidates(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item number) whose signatures meet in some repetition."""
        found_s, found_k = [], []
        for (sig, owner, bitmap), picks, seed in zip(self.tables, self.picks, self.seeds, strict=True):
            if not len(sig):
                continue
            s = signatures(codes, self.mixed, starts, picks, seed)
            maybe = np.flatnonzero(bitmap[(s >> np.uint64(64 - _BITMAP)).astype(np.int64)])
            lo, hi = np.searchsorted(sig, s[maybe], "left"), np.searchsorted(sig, s[maybe], "right")
            n = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            found_s.append(np.repeat(starts[maybe], n))
            found_k.append(owner[at])
        if not found_s:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(found_s), np.concatenate(found_k)]), axis=1)
        return both[0], both[1]


def _extend(item: list[str], doc: list[str], i: int, j: int, most: int, back: bool) -> list[int]:
    """Most item words from (i, j) on that the text follows with 0 … ``most`` differences. Two words written
    as one, or one as two, are no difference. ``back``: both lists are reversed."""
    m, d, start = len(item), len(doc), i

    def follow(i: int, j: int) -> tuple[int, int]:
        while i < m and j < d:
            a, b = item[i], doc[j]
            if a == b:
                i, j = i + 1, j + 1
            elif len(a) > len(b) and j + 1 < d and a == (doc[j + 1] + b if back else b + doc[j + 1]):
                i, j = i + 1, j + 2
            elif len(b) > len(a) and i + 1 < m and b == (item[i + 1] + a if back else a + item[i + 1]):
                i, j = i + 2, j + 1
            else:
                break
        return i, j

    i, j = follow(i, j)
    front, best = {j - i: i}, [i - start]
    for _ in range(most):
        reached: dict[int, int] = {}
        for diagonal, i in front.items():
            j = i + diagonal
            for x, y in ((i + 1, j + 1), (i + 1, j), (i, j + 1)):  # changed, missing, added
                if x <= m and y <= d:
                    x, y = follow(x, y)
                    if reached.get(y - x, -1) < x:
                        reached[y - x] = x
        front = reached or front
        best.append(max(best[-1], max(front.values()) - start))
    return best


def most_differences(item: list[str]) -> int:
    return len(item) // ONE_IN


def longest_run(item: list[str], doc: list[str], most: int = 3) -> list[int]:
    """For 0 … ``most`` differences: the most running item words found in ``doc`` in order with so many words
    changed, missing or added. A run of 20 with two differences, or of 30 with three, has ``SEED`` words
    without any; every such place is extended both ways."""
    grams: dict[tuple, list[int]] = {}
    for i, g in enumerate(zip(*[item[k:] for k in range(SEED)], strict=False)):
        grams.setdefault(g, []).append(i)
    return _from_seeds(item, grams, doc, 0, len(doc), most)


def _from_seeds(item: list[str], grams: dict[tuple, list[int]], doc: list[str], lo: int, hi: int, most: int = 3) -> list[int]:
    """``longest_run`` over the whole text, from seeds that begin in doc[lo:hi]."""
    best, seen = [0] * (most + 1), {}
    back_item, back_doc = item[::-1], doc[::-1]
    part = doc[lo:hi]
    for j, g in enumerate(zip(*[part[k:] for k in range(SEED)], strict=False), lo):
        for i in grams.get(g, ()):
            if seen.get(j - i, -1) >= j:
                continue
            ahead = _extend(item, doc, i, j, most, False)
            behind = _extend(back_item, back_doc, len(item) - i, len(doc) - j, most, True)
            seen[j - i] = j + ahead[0] - SEED
            for e in range(most + 1):
                best[e] = max(best[e], max(ahead[x] + behind[e - x] for x in range(e + 1)))
    return best


def verdict(best: list[int]) -> tuple[int, int] | None:
    """(words, differences) of a passage that counts: at least ``MIN_WORDS``, one difference in ``ONE_IN``."""
    ok = [(n, e) for e, n in enumerate(best) if n >= max(MIN_WORDS, ONE_IN * e)]
    return max(ok, key=lambda x: (x[0], -x[1])) if ok else None


_BUILT: dict[tuple, ItemIndex] = {}


def _index(block: int, items: list[tuple[int, str]], repeats: int, scans: bool) -> ItemIndex:
    """The index of a block of items, built once in each worker process."""
    key = (block, repeats, scans, len(items), hash(tuple(items)))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ItemIndex(items, repeats, scans)
    return _BUILT[key]


def _search(block: int, items, repeats: int, scans: bool):
    """``items``: a broadcast list of (id, text)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(block, items.value, repeats, scans)
        names = {w: c for w, c in index.vocab.items() if c}
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            docs = [words_of(t, scans) for t in batch.column("text").to_pylist()]
            sizes = [len(w) + 1 for w in docs]
            flat = np.zeros(sum(sizes) + 1, np.int32)
            ends = np.cumsum(sizes)
            for w, end in zip(docs, ends.tolist(), strict=True):
                flat[end - len(w) - 1 : end - 1] = [names.get(x, 0) for x in w]
            first = ends - np.array(sizes, dtype=np.int64) if sizes else np.zeros(0, np.int64)
            starts = np.arange(0, len(flat) - 1, STRIDE)
            found, which = index.candidates(flat, starts)
            rows = np.searchsorted(ends, found, "right")
            out: dict[tuple[int, int], tuple[int, int]] = {}
            spots: dict[tuple[int, int], list[int]] = defaultdict(list)
            for row, k, at in zip(rows.tolist(), which.tolist(), (found - first[np.minimum(rows, len(first) - 1)]).tolist(), strict=True):
                spots[(row, k)].append(at)
            for (row, k), where in spots.items():
                doc, item = docs[row], index.words[k]
                # a window meets only inside a passage, so a seed of that passage is near the window
                lo, hi = max(0, min(where) - MIN_WORDS - 4), max(where) + WINDOW + MIN_WORDS + 4
                # cut into pieces of 20 to 39 words, a passage has one with at most its share of differences: three at most
                judged = verdict(_from_seeds(item, index.grams[k], doc, lo, hi))
                if judged and most_differences(item) > 3:
                    judged = verdict(_from_seeds(item, index.grams[k], doc, lo, hi, most_differences(item)))
                if judged:
                    out[(row, k)] = judged
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([index.ids[k] for _, k in out], pa.int64()),
                    pa.array([int(ids[row]) for row, _ in out], pa.int64()),
                    pa.array([n for n, _ in out.values()], pa.int32()),
                    pa.array([e for _, e in out.values()], pa.int32()),
                ],
                ["item_id", "doc_id", "words", "differences"],
            )

    return search


def leaked_items(documents: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, item_text: str, repeats: int = REPEATS, scans: bool = True) -> DataFrame:
    """item_id, doc_id, words, differences: one row per document and item of which it holds a passage, the longest one.

    A passage is at least 20 running words of the item with at most one word in ten changed, missing or
    added. Every document is read whole. Items are shared out by hash into blocks of about ``ITEMS_AT_ONCE`` (one pass over the
    corpus a block), so the broadcast texts of a block are bounded however many items there are; workers build
    the index. Null or short texts hold nothing; items with fewer than 20 words cannot leak; null ids are left out;
    a repeated document id with the same text counts once. ``scans``: see ``words_of``.
    """
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    tests = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("x")).dropna().distinct()
    blocks = max(1, -(-tests.count() // ITEMS_AT_ONCE))
    out = None
    for block in range(blocks):
        part = sorted(map(tuple, tests.where(F.pmod(F.xxhash64("i", "x"), F.lit(blocks)) == block).collect()))
        sent = documents.sparkSession.sparkContext.broadcast(part)
        found = rows.mapInArrow(_search(block, sent, repeats, scans), "item_id bigint, doc_id bigint, words int, differences int")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("words", (-F.col("differences")).alias("d"))).alias("m")
    return out.groupBy("item_id", "doc_id").agg(best).select("item_id", "doc_id", "m.words", (-F.col("m.d")).alias("differences"))
