"""Alignment of two tokenizers over the same texts.

Both tokenizers cut the same bytes, so a text is two ascending lists of byte offsets where tokens end. The
shorter list drives: each of its ends gallops into the longer list, first in doubling steps and then by
halving the step that passed it. Ends found in both lists cut the tokens into groups; the ranks that
neighbouring ends reached say which tokens of the longer list overlap a token of the shorter one.

How many documents hold a pair of tokens linked is counted in two steps: stretches of documents ("blocks") of
about BLOCK bytes name their distinct pairs once, Spark adds them up, and each block gets the totals of its
own pairs back. What moves is pairs of blocks, not pairs of documents.

Defined cases: texts that are null or empty, or whose tokens do not spell space and text byte for byte, have no
tokens: all numbers are zero and the digest is ''. Repeated rows are documents of their own. A text of any
length is encoded whole; one longer than BLOCK is a block of its own. An empty table gives an empty result.
Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import kept, table

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how byte-level BPE cuts a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose class may differ between Unicode versions.
BEYOND = re.compile("[^\x00-\u04ff]")
#: Bytes of text in a block of documents, whose pairs are counted and given their totals together.
BLOCK = 1 << 24
#: Bytes of text whose tokens are in memory at once.
CHUNK = 1 << 20


class Codec:
    """A tokenizer as two tables: the bytes and the decimal number of every id."""

    def __init__(self, spelled: list[bytes]):
        self.bytes = np.array(spelled, object)
        self.length = np.fromiter(map(len, spelled), np.int64, len(spelled))
        # a token's number with the sign that follows it
        self.signs = {sign: np.array([b"%d%s" % (k, sign) for k in range(len(spelled))], object) for sign in (b",", b"|", b";")}

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError


class ByteLevel(Codec):
    """Byte-level BPE over space and text; strings of special tokens are plain text.

    Where the file's merges are in the order of their ids, ranks say all that the merges do, and a text is
    encoded by the faster of the two libraries. Both cut texts by the same pattern; texts with code points
    whose class may depend on a library's Unicode version are left to the library the file was made for.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        added = {t["id"]: t["content"].encode() for t in given.get("added_tokens") or []}
        # printable bytes stand for themselves, the others for the code points from 256 on, in order
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            spelled[k] = added[k] if k in added else bytes(byte_of[c] for c in token)
        super().__init__(spelled)
        merges = [m if isinstance(m, list) else m.split(" ") for m in given["model"]["merges"]]
        by_rank = all(vocabulary.get("".join(m)) == 256 + k for k, m in enumerate(merges))
        cut = given.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not given.get("normalizer")
        self.ranks = None
        if by_rank and plain and not given["model"].get("ignore_merges"):
            ranks = {b: k for k, b in enumerate(spelled[: 256 + len(merges)])}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [self.ranks is not None and (t.isascii() or not BEYOND.search(t)) for t in texts]
        rest = iter(self.tokenizer.encode_batch_fast([" " + t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.ranks.encode_ordinary(" " + t) if p else next(rest).ids for t, p in zip(texts, plain)]


class Pieces(Codec):
    """Sentence pieces with byte fallback; the model puts the space in front itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        spelled = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            spelled.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode())
        super().__init__(spelled)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def _codecs(a_path: str, b_path: str) -> tuple[Codec, Codec]:
    return ByteLevel(a_path), Pieces(b_path)


def gallop(ends: np.ndarray, into: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many of ``into`` are below each of ``ends``, both ascending, searching from ``start``: doubling
    steps up or down until the place is passed, then halving between the last two."""
    n = len(into)
    at = np.clip(start, 0, n - 1)
    up = into[at] < ends
    near, far, step = at.copy(), at.copy(), np.ones(len(at), np.int64)
    going = np.arange(len(at))
    while len(going):
        rising = up[going]
        far[going] = np.where(rising, near[going] + step[going], near[going] - step[going])
        inside = (far[going] >= 0) & (far[going] < n)
        below = into[np.clip(far[going], 0, n - 1)] < ends[going]
        more = inside & (below == rising)
        near[going[more]] = far[going[more]]
        step[going] *= 2
        going = going[more]
    # the last place known to be below, and the first known not to be
    low, high = np.where(up, near, np.maximum(far, -1)), np.where(up, np.minimum(far, n), near)
    going = np.flatnonzero(high - low > 1)
    while len(going):
        middle = (low[going] + high[going]) // 2
        below = into[middle] < ends[going]
        low[going[below]] = middle[below]
        high[going[~below]] = middle[~below]
        going = going[high[going] - low[going] > 1]
    return high


def ranks(short: np.ndarray, long: np.ndarray, apart: int = 32) -> np.ndarray:
    """``gallop`` for all of ``short``: every ``apart``-th end from a proportional guess, the others from
    between their neighbours."""
    if not len(short):
        return np.zeros(0, np.int64)
    posts = np.arange(0, len(short), apart)
    found = gallop(short[posts], long, posts * len(long) // len(short))
    return gallop(short, long, np.interp(np.arange(len(short)), posts, found).astype(np.int64))


class Aligned:
    """Tokens of some documents, side by side: ids ``a`` and ``b``, how many each document has, the ranks of
    common ends, and all links as places in ``a`` and ``b``."""

    def __init__(self, texts: list[str | None], codecs: tuple[Codec, Codec]):
        sides = [self._tokens(texts, c) for c in codecs]
        whole = [x is not None and y is not None for x, y in zip(*sides)]
        ids = [[np.asarray(t if w else [], np.int64) for t, w in zip(side, whole)] for side in sides]
        self.n_a, self.n_b = (np.fromiter(map(len, s), np.int64, len(s)) for s in ids)
        self.a, self.b = (np.concatenate([*s, np.zeros(0, np.int64)]) for s in ids)
        ends_a, ends_b = np.cumsum(codecs[0].length[self.a]), np.cumsum(codecs[1].length[self.b])
        swap = len(ends_a) > len(ends_b)
        short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
        rank = ranks(short, long)
        both = long[rank] == short if len(short) else np.zeros(0, bool)
        own, other = np.flatnonzero(both), rank[both]
        self.common_a, self.common_b = (other, own) if swap else (own, other)
        # a token reaches from where the one before it ended, or behind that if both ended there
        first = np.concatenate([[0], rank[:-1] + both[:-1]]) if len(short) else rank
        width = rank - first + 1
        driver = np.repeat(np.arange(len(short)), width)
        driven = np.repeat(first - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        self.link_a, self.link_b = (driven, driver) if swap else (driver, driven)
        self.groups = self._digests(codecs)

    @staticmethod
    def _tokens(texts: list[str | None], codec: Codec) -> list[list[int] | None]:
        ids = codec.encode([t or "" for t in texts])
        return [i if t and b"".join(codec.bytes[i].tolist()) == b" " + t.encode("utf-8", "replace") else None for i, t in zip(ids, texts)]

    def _digests(self, codecs: tuple[Codec, Codec]) -> list[str]:
        """Digest of every document's groups: numbers of a, then of b, then the next group's."""
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.common_a], last_b[self.common_b] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_a = np.arange(len(self.a)) + np.concatenate([[0], self.common_b + 1])[group_a]
        before_b = np.arange(len(self.b)) + (self.common_a + 1)[group_b]
        line = np.empty(len(self.a) + len(self.b), object)
        line[before_a] = np.where(last_a, codecs[0].signs[b"|"][self.a], codecs[0].signs[b","][self.a])
        line[before_b] = np.where(last_b, codecs[1].signs[b";"][self.b], codecs[1].signs[b","][self.b])
        parts, at, out = line.tolist(), 0, []
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256(b"".join(parts[at : at + n])[:-1]).hexdigest() if n else "")
            at += n
        return out

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Which document every link and every common end is in."""
        stops = np.cumsum(self.n_a)
        return np.searchsorted(stops, self.link_a, "right"), np.searchsorted(stops, self.common_a, "right")


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, a_path: str = BYTE_LEVEL, b_path: str = PIECES, block: int = BLOCK) -> DataFrame:
    """One row per document: (block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links, times), with its
    distinct pairs as numbers within the block and how often it has each, as 32-bit numbers; and one row per
    block without groups_sha256, whose links are its distinct pairs (a's id times 2**32 plus b's) in the order
    of those numbers, as 64-bit numbers, and whose times say in how many documents of the block each is."""
    columns = ["block", "doc_id", *_NUMBERS, "groups_sha256", "links", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = _codecs(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        size = 0
        kind = None

        def closed() -> Iterator[pa.RecordBatch]:
            """The block's rows, its pairs numbered."""
            pairs, which = np.unique(np.concatenate([r[6] for r in rows]), return_inverse=True)
            holders = np.bincount(which, minlength=len(pairs))
            cuts = np.cumsum([len(r[6]) for r in rows])[:-1]
            links = [w.astype(np.uint32).tobytes() for w in np.split(which, cuts)]
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                own = [pa.array([number] * len(part)), pa.array([r[0] for r in part], kind)]
                own += [pa.array([r[k] for r in part], pa.int64()) for k in range(1, 5)]
                own += [pa.array([r[5] for r in part], pa.string()), pa.array(links[at : at + 4096], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, pa.array([r[7].astype(np.uint32).tobytes() for r in part], pa.binary())], columns)
            none = [pa.array([0], pa.int64())] * 4
            sums = [pa.array([pairs.tobytes()], pa.binary()), pa.array([holders.astype(np.uint32).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, kind), *none, pa.nulls(1, pa.string()), *sums], columns)

        for batch in batches:
            kind = batch.column("doc_id").type
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("t").to_pylist()
            at = 0
            while at < len(texts):
                to, some = at, 0
                while to < len(texts) and (to == at or some + len(texts[to] or "") <= CHUNK):
                    some += len(texts[to] or "")
                    to += 1
                x = Aligned(texts[at:to], codecs)
                in_link, in_group = x.documents()
                n_groups, n_links = np.bincount(in_group, minlength=to - at), np.bincount(in_link, minlength=to - at)
                pair = (x.a[x.link_a] << 32) + x.b[x.link_b]
                stops = np.cumsum(n_links)
                for k, stop in enumerate(stops.tolist()):
                    own, times = np.unique(pair[stop - n_links[k] : stop], return_counts=True)
                    rows.append((ids[at + k], int(x.n_a[k]), int(x.n_b[k]), int(n_groups[k]), int(n_links[k]), x.groups[k], own, times))
                size += some
                at = to
                if size >= block:
                    yield from closed()
                    rows, size, number = [], 0, number + 1
        if rows:
            yield from closed()

    types = f"block long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return docs.select("doc_id", F.col("text").alias("t")).mapInArrow(run, f"{types}, links binary, times binary")


def block_pairs(found: DataFrame) -> DataFrame:
    """(block, at, a, b, docs): the distinct pairs of every block with their numbers, and its documents with each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, links, times in zip(*(batch.column(c).to_pylist() for c in ("block", "links", "times"))):
                pair, docs = np.frombuffer(links, np.int64), np.frombuffer(times, np.uint32).astype(np.int64)
                own = [np.full(len(pair), block), np.arange(len(pair), dtype=np.int32), (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32), docs]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], ["block", "at", "a", "b", "docs"])

    return found.filter("groups_sha256 is null").select("block", "links", "times").mapInArrow(run, "block long, at int, a int, b int, docs long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents each pair is linked, and whether no other b has more with a."""
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def token_alignment(docs: DataFrame, a_path: str = BYTE_LEVEL, b_path: str = PIECES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and the corpus-wide
    ``pair_counts``."""
    found = kept(aligned(docs, a_path, b_path, block), "aligned")
    pairs = block_pairs(found)
    counts = kept(pair_counts(pairs), "pair_counts")
    totals = pairs.join(counts, ["a", "b"]).select("block", "at", "count", "best")
    numbers = ["doc_id", *_NUMBERS, "groups_sha256", "n_best", "count_sum"]

    def run(rows: pa.Table, own_pairs: pa.Table) -> pa.Table:
        order = np.argsort(own_pairs.column("at").to_numpy())
        count, best = (own_pairs.column(c).to_numpy()[order].astype(np.int64) for c in ("count", "best"))
        n_best, total = [], []
        for links, times in zip(rows.column("links").to_pylist(), rows.column("times").to_pylist()):
            own, n = np.frombuffer(links, np.uint32), np.frombuffer(times, np.uint32).astype(np.int64)
            n_best.append(int((best[own] * n).sum()))
            total.append(int((count[own] * n).sum()))
        return rows.select(numbers[:-2]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    rows = found.filter("groups_sha256 is not null")
    return rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(run, types), counts


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment(table(spark, folder, "documents"))[0]
