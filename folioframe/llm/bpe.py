"""Token counts by byte-pair merging with a heap and a linked list (operator 8)."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import mapped

#: The pieces of the byte-level scheme, with Unicode's White_Space spelled out.
WHITE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Entries that a worker keeps of words and of pieces; beyond that they are counted anew each time.
KEPT_WORDS, KEPT_PIECES = 800_000, 800_000
#: Texts beyond this many characters go through the pieces one by one instead of as a list.
LONG = 4_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """The merge table of one tokenizer file, and the counting of one piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.made = [a + b for a, b in pairs]
        self.symbol = byte_symbols()
        self.special = [t["content"] for t in spec["added_tokens"]]

    def count(self, piece: bytes) -> int:
        """Initial symbols minus merges; the lowest-rank pair, leftmost first, is merged until none is left."""
        sym = [self.symbol[b] for b in piece]
        n, get = len(sym), self.rank.get
        now = list(map(get, zip(sym, sym[1:])))  # the rank of the pair that begins at each place
        heap = [(r, i) for i, r in enumerate(now) if r is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push, made = heapq.heappop, heapq.heappush, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now.append(None)
        merges = 0
        while heap:
            r, i = pop(heap)
            if now[i] != r:
                continue  # the pair of this entry is gone
            j = after[i]
            sym[i], now[j], k = made[r], None, after[j]
            after[i] = k
            merges += 1
            if k < n:
                before[k] = i
                now[i] = q = get((sym[i], sym[k]))
                if q is not None:
                    push(heap, (q, i))
            else:
                now[i] = None
            if (h := before[i]) >= 0:
                now[h] = q = get((sym[h], sym[i]))
                if q is not None:
                    push(heap, (q, h))
        return n - merges


class _Pieces(dict):
    def __init__(self, merges: Merges):
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        n = self.merges.count(piece.encode())
        if len(self) < KEPT_PIECES:
            self[piece] = n
        return n


class _Words(dict):
    """Counts of what stands between two single spaces, the space before it included."""

    def __init__(self, pieces: _Pieces, split: regex.Pattern):
        self.pieces, self.split = pieces, split

    def __missing__(self, word: str) -> int:
        n = sum(map(self.pieces.__getitem__, self.split.findall(" " + word)))
        if len(self) < KEPT_WORDS:
            self[word] = n
        return n


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str):
        merges = Merges(path)
        self.split = regex.compile(PIECES)
        self.special = merges.special
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pieces = _Pieces(merges)
        self.words = _Words(self.pieces, self.split)
        #: A space beside other white space: there the words can't be taken one by one.
        self.wide = re.compile(rf" [{WHITE}]|[{WHITE}] ")

    def _plain(self, text: str) -> int:
        if len(text) > LONG:
            return sum(self.pieces[m[0]] for m in self.split.finditer(text))
        if self.wide.search(text):
            return sum(map(self.pieces.__getitem__, self.split.findall(text)))
        first, *rest = text.split(" ")
        return sum(map(self.pieces.__getitem__, self.split.findall(first))) + sum(map(self.words.__getitem__, rest))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker process and file."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Counts the tokens of every text of docs with the byte-level BPE file at path tokenizer.

    Returns (id, n_bytes, n_tokens, over_limit). A text's special strings count as one token each. A
    null text counts as empty: zero bytes, zero tokens. Null, repeated and tied ids stay as they are,
    one row each; other columns are ignored; an empty table gives an empty result. The texts never
    leave their partition; no id is made. The file must be at that path on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("_text"))

    def run(batches):
        count = counter(tokenizer).count
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(1)
            values = [x or "" for x in column.to_pylist()]
            n = [count(x) for x in values]
            size = [len(x.encode()) for x in values]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return mapped(frame, run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
