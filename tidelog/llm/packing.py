"""Filling containers of fixed capacity with texts measured in tokens."""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import spread_out

CAPACITY = 4096
#: Items that are packed together. Blocks are packed independently; each leaves about one underfull container.
BLOCK_ITEMS = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the byte-level BPE of TOKENIZER cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}


def token_counter(path: str):
    """Function from texts to token counts. path: ranks of a byte-level BPE (token in base64 and rank a line)."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoding = _encoders[path]
    return lambda texts: [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]


def fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """First packing: largest item first, into the fullest bin that takes it. Returns bins of item numbers."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (space left, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        bisect.insort(room, (left, b))
    return bins


class _Units:
    """What may come back from a bin in an exchange: nothing, one item or two, of all underfull bins, sorted by size."""

    def __init__(self, content: dict[int, list[int]], fill: dict[int, int], sizes: list[int], capacity: int):
        self.parts = [(b, held) for b, items in content.items() if fill[b] < capacity for held in _takeable(items)]
        size = np.array([sum(sizes[i] for i in held) for _, held in self.parts], np.int64)
        order = np.argsort(size, kind="stable")
        self.size = size[order]
        self.parts = [self.parts[i] for i in order]
        self.bin = np.array([b for b, _ in self.parts], np.int64)
        self.count = np.array([len(held) for _, held in self.parts], np.int64)

    def best(self, out_size: int, out_count: int, a: int, fill: np.ndarray, fresh: np.ndarray, room: int, capacity: int) -> tuple[int, int]:
        """(gain in the sum of squared fills, unit) of the best exchange of an out of bin a for a unit; gain 0 if there is none.

        Shifting d from a bin filled x to one filled y changes the sum by 2d(y - x + d). room: the most that any bin has left.
        """
        low, high = np.searchsorted(self.size, (out_size - room, out_size))
        if low == high:
            return 0, -1
        b, d = self.bin[low:high], out_size - self.size[low:high]
        y = fill[b]
        gain = np.where(fresh[b] & (b != a) & (d <= capacity - y) & (self.count[low:high] + out_count <= 3), d * (y - fill[a] + d), 0)
        at = int(gain.argmax())
        return int(gain[at]), low + at


def _takeable(items: list[int]) -> list[tuple[int, ...]]:
    return [(), *((i,) for i in items), *((i, j) for n, i in enumerate(items) for j in items[n + 1 :])]


def local_search(bins: list[list[int]], sizes: list[int], capacity: int, rounds: int | None = None) -> list[list[int]]:
    """Exchange items between underfull bins, each time raising the sum of squared fills, until none helps or there are as few bins as can be.

    Changes: move one item or two, exchange one for one, two for one or one for two, with any other underfull bin; of all that are
    open to a bin the best is made. The emptiest bins give first, so that they run empty and go. A bin that a round has changed
    is a partner again in the next. The sum rises by whole numbers, so the search ends. rounds: for tests.
    """
    content = {b: list(items) for b, items in enumerate(bins)}
    fill = np.array([sum(sizes[i] for i in items) for items in bins], np.int64)
    least = -(-int(fill.sum()) // capacity)
    while len(content) > least and (rounds is None or rounds > 0):
        rounds = None if rounds is None else rounds - 1
        units = _Units(content, fill, sizes, capacity)
        fresh = np.ones(len(bins), bool)
        room = capacity - min((int(fill[b]) for b in content), default=capacity)
        changed = False
        for a in sorted((b for b in content if fill[b] < capacity), key=lambda b: fill[b]):
            while content[a]:
                outs = _takeable(content[a])[1:]
                found = [units.best(sum(sizes[i] for i in out), len(out), a, fill, fresh, room, capacity) for out in outs]
                n = max(range(len(outs)), key=lambda k: found[k][0])
                if not found[n][0]:
                    break
                b, back = units.parts[found[n][1]]
                content[a] = [i for i in content[a] if i not in outs[n]] + list(back)
                content[b] = [i for i in content[b] if i not in back] + list(outs[n])
                shift = sum(sizes[i] for i in outs[n]) - sum(sizes[i] for i in back)
                fill[a] -= shift
                fill[b] += shift
                fresh[[a, b]] = False
                changed = True
            if not content[a]:
                del content[a]
        if not changed:
            break
    return [content[b] for b in sorted(content)]


def pack_sizes(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item; items of size 0 take no room and go to bin 0."""
    real = [i for i, s in enumerate(sizes) if s > 0]
    bins = local_search(fit_decreasing([sizes[i] for i in real], capacity), [sizes[i] for i in real], capacity)
    where = [0] * len(sizes)
    for b, items in enumerate(bins):
        for i in items:
            where[real[i]] = b
    return where


def token_lengths(documents: DataFrame, id_column: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of every whole text; null and empty texts have 0. _row numbers the rows (as they lie in the input)."""
    files = documents.sparkSession.sparkContext
    shipped = os.path.basename(tokenizer) if _ship(files, tokenizer) else None

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(SparkFiles.get(shipped) if shipped else tokenizer)
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "_row": f["_row"], "n_tokens": np.array(count(f["t"]), dtype="int64")})

    lean = spread_out(documents.select(F.col(id_column).alias("id"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("_row")))
    kind = dict(documents.dtypes)[id_column]
    return lean.mapInPandas(run, f"id {kind}, _row bigint, n_tokens bigint").withColumnRenamed("id", id_column)


def _ship(context: SparkContext, tokenizer: str) -> bool:
    """Send the tokenizer's file to the executors, which need not have it; whether the driver has it to send."""
    if not os.path.isfile(tokenizer):
        return False
    if not any(os.path.basename(f) == os.path.basename(tokenizer) for f in context.listFiles):
        context.addFile(tokenizer)
    return True


def pack(documents: DataFrame, id_column: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Put all texts into containers: id, piece_no, start_token, n_tokens, container.

    A text of more than capacity tokens is split into full pieces, each a container of its own, and a rest; no other text
    is. Method: texts and rests are spread at random over blocks of about block_items; in each block a first packing is
    improved by exchanging one item for one, two for one, or moving items between underfull bins, each step increasing the
    squared fill until bins run empty and no exchange helps. Only ids and lengths are shuffled. Containers are named by
    their block.

    Null and empty texts are items of 0 tokens, which share the block's first container; repeated rows are items of
    their own; null and repeated ids are kept, and spread like others; an empty table has no containers; other columns are
    ignored.
    """
    lengths = token_lengths(documents, id_column, text, tokenizer)
    blocks = max(1, -(-documents.count() // block_items))  # metadata only, for Parquet
    kind = dict(documents.dtypes)[id_column]

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        full, rest = f["n_tokens"] // capacity, f["n_tokens"] % capacity
        f = f.assign(full=full, rest=rest).sort_values(["rest", "_row"], ascending=[False, True], ignore_index=True)
        f["place"] = pack_sizes(f["rest"].tolist(), capacity)
        f["block"] = key[0]
        return f[[id_column, "_row", "block", "full", "rest", "place"]]

    packed = lengths.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")).groupBy("_block").applyInPandas(run, f"`{id_column}` {kind}, _row bigint, block int, full bigint, rest bigint, place int")
    # Pieces are made behind the packing: a block holds one row a text, however long it is.
    last = F.when((F.col("rest") > 0) | (F.col("full") == 0), F.col("full")).otherwise(F.col("full") - 1)
    pieces = packed.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    is_full = F.col("piece_no") < F.col("full")
    name = F.when(is_full, F.concat_ws("-", F.lit("full"), "_row", "piece_no")).otherwise(F.concat_ws("-", "block", "place"))
    return pieces.select(id_column, F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("start_token"), F.when(is_full, F.lit(capacity).cast("long")).otherwise(F.col("rest")).alias("n_tokens"), name.alias("container"))
