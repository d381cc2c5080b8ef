"""Evaluation passages that stand in training texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.text import word_bytes
from tidelog.session import spread_out

#: Words in succession that make a leak, and the share of them that may be altered.
LEAST_WORDS, ALTERED = 20, 0.1
#: Embeddings, samples of each, symbols of a sample. A window with Hamming distance h in 40 symbols is found with
#: probability 1 - (1 - (1 - h/40)^SYMBOLS)^(EMBEDDINGS * SAMPLES): 0.9999 at h = 12.
EMBEDDINGS, SAMPLES, SYMBOLS = 4, 8, 4
#: Items of one index, and characters of their texts (an item with more has an index of its own). More items are searched for block by
#: block, each with its own pass over the texts.
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 4_000_000
#: Windows, and pairs of windows, that are looked at together; words of texts.
CHUNK, PIECE = 10_000, 500_000
_SEED = 20_240_101


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (murmur3's finalizer)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PassageIndex:
    """CGK embeddings of all windows of LEAST_WORDS words of some items, by sampled symbols.

    The embedding walks through a window: step j writes the current word and goes on to the next one if a random bit
    that belongs to j and the word says so. After an altered, inserted or dropped word two walks soon meet again, so
    few edits become a small Hamming distance. A few sampled steps that agree make a candidate.

    Windows have LEAST_WORDS words, not the items' size, because a part of an item of that length is a leak already.
    """

    def __init__(self, ids: list, texts: list[str | None], width: int = LEAST_WORDS):
        self.width = width
        self.edits = int(width * ALTERED)
        # Edits that may lie in every window of a quotation: one of less than two windows' length has this budget, and a longer one has a window with no more.
        self.most = int((2 * width - 1) * ALTERED)
        # They part the true words of such a window into most + 1 runs, one of which has at least this many words.
        self.run = max(1, -(-(width - self.most) // (self.most + 1)))
        same: dict[tuple, list] = {}  # items of the same words are one here
        for i, t in zip(ids, texts):
            if len(w := word_bytes(t)) >= width:
                same.setdefault(tuple(w), []).append(i)
        self.ids = list(same.values())
        self.numbers = {w: n + 1 for n, w in enumerate(dict.fromkeys(w for ws in same for w in ws))}
        self.hashes = np.array([0, *(xxhash.xxh3_64_intdigest(w) | 1 for w in self.numbers)], dtype=np.uint64)
        items = [np.fromiter((self.numbers[w] for w in ws), np.int32, len(ws)) for ws in same]
        self.items = [self.hashes[i] for i in items]
        rng = np.random.default_rng(_SEED)
        self.steps = 2 * width
        self.bits = rng.integers(0, 2**63, (EMBEDDINGS, self.steps), dtype=np.uint64)
        self.samples = np.array([[np.sort(rng.choice(self.steps, SYMBOLS, replace=False)) for _ in range(SAMPLES)] for _ in range(EMBEDDINGS)])
        sizes = np.array([len(i) - width + 1 for i in items], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(items)), sizes)
        self.at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, width) for x in self.items]) if items else np.zeros((0, width), np.uint64)
        self.spelled = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, width) for x in items]) if items else np.zeros((0, width), np.int32)
        runs = np.unique(np.concatenate([self._runs(i) for i in items])) if items else np.zeros(0, np.uint64)
        self.run_bits = max(16, int(len(runs) * 16).bit_length())
        self.run_table = np.zeros(1 << self.run_bits, dtype=bool)
        self.run_table[runs >> np.uint64(64 - self.run_bits)] = True
        self.runs = runs
        self.tables = []
        for signature in self.signatures(self.windows):
            order = np.argsort(signature, kind="stable")
            self.tables.append((signature[order], order))

    def _runs(self, numbers: np.ndarray) -> np.ndarray:
        """A hash of the run of words that begins at each place with enough words after it."""
        n = len(numbers) - self.run + 1
        h = np.zeros(max(n, 0), np.uint64)
        for j in range(self.run if n > 0 else 0):
            h = (h + numbers[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def signatures(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """One array of sampled symbols' hashes for each embedding and sample."""
        n = len(windows)
        padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
        here = np.arange(n)
        for e in range(EMBEDDINGS):
            at = np.zeros(n, dtype=np.int64)
            walk = np.empty((self.steps, n), np.uint64)
            for j in range(self.steps):
                symbol = padded[here, at]
                walk[j] = symbol
                at = np.minimum(at + (_mix(symbol ^ self.bits[e, j]) >> np.uint64(63)).astype(np.int64), self.width)
            for picks in self.samples[e]:
                h = np.zeros(n, np.uint64)
                for j in picks:
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + walk[j])
                yield h

    def candidates(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs (text window, item window) that agree on any sample; in pieces of about PIECE pairs, without repeats in a piece."""
        held: list = []
        size = 0

        def pairs() -> np.ndarray:
            found = np.unique(np.concatenate(held))
            return np.stack([found // len(self.windows), found % len(self.windows)], axis=1)

        for signature, (table, order) in zip(self.signatures(windows), self.tables):
            low, high = np.searchsorted(table, signature, "left"), np.searchsorted(table, signature, "right")
            hit = np.flatnonzero(high > low)
            while len(hit):
                before = np.cumsum(high[hit] - low[hit])
                some = max(1, int(np.searchsorted(before, PIECE, "right")))  # at least one window, whatever it meets
                take, n = hit[:some], (high - low)[hit[:some]]
                held.append(np.repeat(take, n) * len(self.windows) + order[np.repeat(low[take], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
                size += len(held[-1])
                hit = hit[some:]
                if size >= PIECE:
                    yield pairs()
                    held, size = [], 0
        if held:
            yield pairs()

    def search(self, text: str | None) -> dict:
        """Item number -> (first word of the text's region, words of the item quoted, edits), for items that leaked into the text."""
        return {n: hit for _, n, hit in self.search_all([text])}

    def search_all(self, texts: Iterable[str | None]) -> list[tuple[int, int, tuple[int, int, int]]]:
        """(text's place, item number, what search() gives) for all leaks of some texts, which are looked at together, PIECE words and more at a time."""
        found: list = []
        if not self.items:
            return found
        places: list[int] = []
        numbers: list[np.ndarray] = []
        held = 0
        get = self.numbers.get
        for place, t in enumerate(texts):
            ws = word_bytes(t)
            if len(ws) < self.width - self.edits:
                continue
            places.append(place)
            numbers.append(np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws)))
            held += len(ws)
            if held >= PIECE:
                found += self._search(places, numbers)
                places, numbers, held = [], [], 0
        return found + self._search(places, numbers) if places else found

    def _search(self, places: list[int], numbers: list[np.ndarray]) -> list:
        # Words left out at the end make a quotation end before its window does: every text is followed by unknown words.
        pads = [max(self.most, self.width - len(x)) for x in numbers]
        whole = np.concatenate([x for n, p in zip(numbers, pads) for x in (n, np.zeros(p, np.int32))])
        sizes = np.array([len(n) + p for n, p in zip(numbers, pads)])
        first = np.cumsum(sizes) - sizes
        total = len(whole)
        known = np.concatenate([[0], np.cumsum(whole > 0)])
        # Some window of a quotation lies in its text, has no more unknown words than self.most, and holds a run of words of the item.
        h = self._runs(whole)
        at = np.flatnonzero(self.run_table[h >> np.uint64(64 - self.run_bits)])
        at = at[known[at + self.run] - known[at] == self.run]
        at = at[np.isin(h[at], self.runs)]
        if not len(at):
            return []
        begun = np.zeros(total + 1, np.int64)
        np.add.at(begun, np.maximum(at + self.run - self.width, 0), 1)
        np.add.at(begun, at + 1, -1)
        starts = np.flatnonzero(np.cumsum(begun)[: total - self.width + 1] > 0)
        starts = starts[known[starts + self.width] - known[starts] >= self.width - self.most]
        text = np.searchsorted(first, starts, "right") - 1
        inside = starts + self.width <= first[text] + sizes[text]
        starts, text = starts[inside], text[inside]
        hashed = self.hashes[whole]
        every = np.lib.stride_tricks.sliding_window_view(whole, self.width)
        verified: dict = {}
        settled = np.zeros(0, np.int64)  # text and item that are verified, text, item and place that were tried
        tried = np.zeros(0, np.int64)
        span = 2 * (total + int(self.at.max()) + 1)
        for low in range(0, len(starts), CHUNK):
            here, owner = starts[low : low + CHUNK], text[low : low + CHUNK]
            windows = every[here]
            for pairs in self.candidates(self.hashes[windows]):
                both = owner[pairs[:, 0]] * len(self.items) + self.owner[pairs[:, 1]]
                place = both * span + (here[pairs[:, 0]] - self.at[pairs[:, 1]]) + span // 2
                new = ~(np.isin(both, settled) | np.isin(place, tried))
                pairs, both, place = pairs[new], both[new], place[new]
                # One pair a place first: most others of a leak need no look then.
                ahead = np.zeros(len(pairs), bool)
                ahead[np.unique(place, return_index=True)[1]] = True
                for chosen in (ahead, ~ahead):
                    at = np.flatnonzero(chosen & ~(np.isin(both, settled) | np.isin(place, tried)))
                    for part in range(0, len(at), CHUNK):
                        some = at[part : part + CHUNK]
                        a, b = windows[pairs[some, 0]], self.spelled[pairs[some, 1]]
                        shared = (b[:, :, None] == a[:, None, :]).any(axis=2).sum(axis=1)
                        some = some[shared >= self.width - self.most]
                        some = some[np.unique(place[some], return_index=True)[1]]
                        for i in some:
                            d, n = divmod(int(both[i]), len(self.items))
                            if (d, n) not in verified:
                                hit = self._verify(n, int(place[i] - both[i] * span - span // 2 - first[d]), hashed[first[d] : first[d] + sizes[d]])
                                if hit:
                                    verified[d, n] = hit
                        tried = np.concatenate([tried, place[some]])
                        settled = np.array([d * len(self.items) + n for d, n in verified], np.int64)
        return [(places[d], n, hit) for (d, n), hit in verified.items()]

    def _verify(self, n: int, shift: int, text: np.ndarray) -> tuple[int, int, int] | None:
        """Look for item n in a text where its first word would stand at shift."""
        item = self.items[n]
        slack = int(len(item) * ALTERED) + 1
        low = max(0, shift - slack)
        hit = quotation(item.tolist(), text[low : max(0, shift + len(item) + slack)].tolist(), self.width)
        return (low + hit[0], hit[1], hit[2]) if hit else None


def quotation(item: list[int], region: list[int], least: int, altered: float = ALTERED) -> tuple[int, int, int] | None:
    """A stretch of at least `least` words of item that stands in region, beginning and ending with a true word, with at
    most altered * length edits (words replaced, put in or left out). Exact: furthest-reaching paths by edits.

    Returns (start in region, words of the item, edits), or None.
    """
    where: dict[int, list[int]] = {}
    for j, w in enumerate(region):
        if w:
            where.setdefault(w, []).append(j)
    most = int(len(item) * altered)

    def slide(i: int, j: int) -> int:
        while i < len(item) and j < len(region) and item[i] == region[j]:
            i, j = i + 1, j + 1
        return i

    for i0 in range(len(item) - least + 1):
        for j0 in where.get(item[i0], ()):
            if i0 and j0 and item[i0 - 1] == region[j0 - 1]:
                continue  # inside a run that was tried from its start
            reach = {j0 - i0: slide(i0, j0)}
            if reach[j0 - i0] - i0 >= least:
                return j0, reach[j0 - i0] - i0, 0
            for e in range(1, most + 1):
                step: dict[int, int] = {}
                for d, i in reach.items():
                    for to, at in ((d, i + 1), (d + 1, i), (d - 1, i + 1)):
                        if at <= len(item) and at + to <= len(region) and at > step.get(to, -1):
                            step[to] = at
                reach = {}
                for d, i in step.items():
                    reach[d] = slide(i, i + d)
                    if reach[d] > i and (n := reach[d] - i0) >= least and e <= n * altered:
                        return j0, n, e
                if not reach:
                    break
    return None


def leaked(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, at_word, n_words, n_edits) for each text and item of which at least LEAST_WORDS words in succession stand in it.

    Method: windows of LEAST_WORDS words of the texts are embedded (CGK), looked up by sampled symbols, and candidates are
    verified exactly by edit distance over words. Embedded are the windows that hold a run of words of an item, as every
    window with few enough edits does. The index is made of a block of about block_items items or block_chars characters, so
    what is broadcast has a bound; further blocks are searched in further passes, and their results united. Texts are
    shuffled once if the input has fewer partitions than there are tasks. Letter case, punctuation, accents, spacing and
    markup do not count.

    Null, empty and short texts and items give nothing, whole texts of any length are searched, repeated rows give
    repeated results, an empty side gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    lean = spread_out(documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")))
    kinds = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, at_word bigint, n_words bigint, n_edits bigint"
    passages = items.filter(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    n, chars = passages.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-chars // block_chars))
    result = None
    for b in range(blocks):
        rows = passages.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect()  # about block_items rows
        index = spark.sparkContext.broadcast(PassageIndex([r.i for r in rows], [r.t for r in rows]))

        def run(frames: Iterable[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for f in frames:
                ids = f["d"].tolist()
                out = [(ids[place], i, *hit) for place, n, hit in index.value.search_all(f["t"]) for i in index.value.ids[n]]
                yield pd.DataFrame(out, columns=[doc_id, item_id, "at_word", "n_words", "n_edits"])

        part = lean.mapInPandas(run, schema)
        result = part if result is None else result.unionByName(part)
    return result
