"""Alignment of two tokenizers over the same texts.

A text's tokens of tokenizer A (byte-level merges) and of tokenizer B (pieces with byte fallback) stand for the same bytes, a space and the
text. Where a token of A and a token of B end at the same byte both id lists can be cut: both lists of ends are sorted, so one search
of A's ends in B's tells which are common, and in order these slice both lists into groups. Within a slice every token of A is linked with each
token of B whose bytes it overlaps; two ends next to each other in the slice's merged ends enclose the bytes of exactly one link.

A pair of ids counts once for each document that links it. The rows that leave a task are chunks: some documents with the distinct
pairs they hold, so that a pair is shuffled once a chunk and not once a document; the counts come back to the chunks the same way. A chunk is
closed by the number of its links, so its size does not grow with the table, and a text longer than that is a chunk of its own.

Ids come from the libraries of the two files. Where the order of A's merges is the order of its ids, texts of plain characters are encoded by
tiktoken from A's own vocabulary, with the same ids in a third of the time.

Defined results: null and empty texts, and texts that a tokenizer does not give back byte for byte (as with U+2581 in the text), have no
tokens, zeros, and an empty group string; repeated rows are rows of their own and each counts as a document; a null id is kept; very long texts are
encoded whole, in memory in proportion to their length; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.session import cut, work_path

from .catalog import query, table

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
# Texts of these characters alone, on whose classes all libraries agree, are split by tiktoken's expressions, which are faster.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ\t\n\r !-~]*")
# Fixed value: how a byte-level vocabulary of this kind splits texts before it merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for a byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Aligner:
    """Both tokenizers, from the bytes of their files."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_str(byte_bpe.decode()), sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        special = {x.content for x in self.a.get_added_tokens_decoder().values()}
        self.table_a, self.quick = [b""] * self.a.get_vocab_size(), None
        for piece, i in vocabulary.items():
            self.table_a[i] = piece.encode() if piece in special else bytes(letters[c] for c in piece)
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in json.loads(byte_bpe)["model"]["merges"]]
        if merged == sorted(merged):        # then a piece's rank is its id
            self.quick = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks={self.table_a[i]: i for p, i in vocabulary.items() if p not in special}, special_tokens={}).encode_ordinary
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.table_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.table_a, self.table_b))
        self.numbers = [f"{i}{end}".encode() for i in range(max(len(self.table_a), len(self.table_b))) for end in ",|;"]

    def ids(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """A's and B's ids of a space and each text; both empty if a tokenizer does not give its bytes back."""
        out = []
        for text, ids_b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            whole = " " + (text or "")
            raw = whole.encode()
            plain = self.quick is not None and PLAIN.fullmatch(whole) is not None
            ids_a = self.quick(whole) if plain else self.a.encode(whole, add_special_tokens=False).ids
            same = text and raw == b"".join(map(self.table_b.__getitem__, ids_b)) and (plain or raw == b"".join(map(self.table_a.__getitem__, ids_a)))
            out.append((ids_a, ids_b) if same else ([], []))
        return out

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Both ids of every link, in the order of the text, and the group string."""
        if not len(ids_a):
            return ids_a, ids_b, b""
        ends_a, ends_b = np.cumsum(self.lengths_a[ids_a]), np.cumsum(self.lengths_b[ids_b])
        # for each end of A: how many tokens of B end before it, and whether one ends there
        upto = np.searchsorted(ends_b, ends_a, side="right")
        both = ends_b[np.maximum(upto, 1) - 1] == ends_a
        before = upto - both
        # the slices: group g holds the tokens up to upto_a[g] and upto_b[g]
        upto_a, upto_b = np.flatnonzero(both) + 1, upto[both]
        sizes_a, sizes_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        last_a, last_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        last_a[upto_a - 1], last_b[upto_b - 1] = 1, 2
        spelled = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        spelled[np.arange(len(ids_a)) + np.repeat(upto_b - sizes_b, sizes_a)] = 3 * ids_a.astype(np.int64) + last_a
        spelled[np.arange(len(ids_b)) + np.repeat(upto_a, sizes_b)] = 3 * ids_b.astype(np.int64) + last_b
        groups = b"".join(map(self.numbers.__getitem__, spelled.tolist()))[:-1]
        # the links of all slices: one for each end in the merged ends, A's ends and those that B has alone, each at its place in the order
        alone = np.flatnonzero(last_b == 0)
        inside = np.searchsorted(ends_a, ends_b[alone])
        at_a, at_b = np.arange(len(ids_a)) + before - (np.cumsum(both) - both), np.arange(len(alone)) + inside
        link_a, link_b = np.empty(len(ids_a) + len(alone), dtype=ids_a.dtype), np.empty(len(ids_a) + len(alone), dtype=ids_b.dtype)
        link_a[at_a], link_a[at_b], link_b[at_a], link_b[at_b] = ids_a, ids_a[inside], ids_b[before], ids_b[alone]
        return link_a, link_b, groups

    def aligned(self, texts: list[str | None], at_once: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
        """A's and B's ids of each text, both ids of its links, its group string."""
        for at in range(0, len(texts), at_once):
            for ids_a, ids_b in self.ids(texts[at:at + at_once]):
                a, b = np.array(ids_a, dtype=np.int32), np.array(ids_b, dtype=np.int32)
                yield a, b, *self.align(a, b)


def files(byte_bpe: str, piece_bpe: str) -> tuple[bytes, bytes]:
    out = []
    for path in (byte_bpe, piece_bpe):
        with open(path, "rb") as f:
            out.append(f.read())
    return out[0], out[1]


def alignments(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """The alignment of every text itself: doc_id, a_ids, b_ids, links (array of structs a, b, in the order of the text) and groups, the string
    `a1,a2|b1;a3|b2,b3` of ids in order."""
    shared = docs.sparkSession.sparkContext.broadcast(files(byte_bpe, piece_bpe))

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(*shared.value)
        for part in parts:
            for given, (a, b, link_a, link_b, groups) in zip(part["doc_id"], aligner.aligned(part["text"].tolist())):
                yield pd.DataFrame({"doc_id": pd.Series([given], dtype="string"), "a_ids": [a], "b_ids": [b], "links": [[{"a": x, "b": y} for x, y in zip(link_a.tolist(), link_b.tolist())]], "groups": [groups.decode()]})
    given = docs.select(F.col(doc_id).cast("bigint").cast("string").alias("doc_id"), F.col(text).alias("text"))
    found = given.mapInPandas(each, "doc_id string, a_ids array<int>, b_ids array<int>, links array<struct<a: int, b: int>>, groups string")
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
CHUNK = ("chunk bigint, doc_id array<bigint>, bare array<boolean>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
         "upto array<int>, at array<int>, times array<int>, pair array<bigint>, docs array<int>")


def chunks(docs: DataFrame, text: str, doc_id: str, byte_bpe: str, piece_bpe: str, links: int, rows: int) -> DataFrame:
    """One row for each chunk of documents with about `links` distinct links (or `rows` documents). `pair` has the chunk's distinct id
    pairs (A's id above 32 bits of B's) and `docs` how many of its documents hold each; document i's pairs are those at `at[upto[i - 1]:upto[i]]`, with
    `times` its links of the pair."""
    shared = docs.sparkSession.sparkContext.broadcast(files(byte_bpe, piece_bpe))

    def pack(number: int, held: list[tuple]) -> pd.DataFrame:
        doc_ids, numbers, digests, pairs, times = zip(*held)
        flat = np.concatenate(pairs)
        distinct, at, n = np.unique(flat, return_inverse=True, return_counts=True)
        row = {"chunk": number, "doc_id": np.array([0 if x is None else x for x in doc_ids], dtype=np.int64), "bare": np.array([x is None for x in doc_ids]),
               **{c: np.array(v, dtype=np.int64) for c, v in zip(COUNTS, zip(*numbers))}, "groups_sha256": list(digests),
               "upto": np.cumsum([len(p) for p in pairs]).astype(np.int32), "at": at.astype(np.int32), "times": np.concatenate(times).astype(np.int32), "pair": distinct, "docs": n.astype(np.int32)}
        return pd.DataFrame([row])

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        aligner, number, held, size = Aligner(*shared.value), TaskContext.get().partitionId() << 32, [], 0
        for part in parts:
            for given, (a, b, link_a, link_b, groups) in zip(part["doc_id"], aligner.aligned(part["text"].tolist())):
                pairs, times = np.unique(link_a.astype(np.int64) << 32 | link_b, return_counts=True)
                held.append((None if pd.isna(given) else int(given), (len(a), len(b), len(a) + len(b) - len(link_a), len(link_a)),
                             hashlib.sha256(groups).hexdigest() if groups else "", pairs, times))
                size += len(pairs)
                if size >= links or len(held) >= rows:
                    yield pack(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield pack(number, held)
    given = docs.select(F.col(doc_id).cast("bigint").cast("string").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInPandas(each, CHUNK)


def align_tokenizers(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, links: int = 400_000, rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Two tables. The documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is their A id's highest), count_sum (of all
    links), groups_sha256. The pairs: a, b, count (documents that link them), best (whether it is a's highest count)."""
    spark = docs.sparkSession
    path = work_path(spark, "aligned")
    # a file is read a batch at a time, and a batch would be all chunks of a task, which grow with the input: few to a file keep it small
    chunks(docs, text, doc_id, byte_bpe, piece_bpe, links, rows).write.option("maxRecordsPerFile", 8).parquet(path)
    met = spark.read.parquet(path).select("chunk", F.posexplode(F.arrays_zip("pair", "docs")).alias("at", "x")).select("chunk", "at", "x.pair", "x.docs")
    counted = cut(met.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32).cast("int")))
    highest = counted.groupBy("a").agg(F.max("count").alias("most"))       # at most one row for each id of A's vocabulary
    counts = counted.join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    known = met.select("chunk", "at", "pair").join(counts, "pair").select("chunk", "at", "count", "best")

    def settle(mine: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        """A chunk's documents, with the counts of its pairs."""
        row = mine.iloc[0]
        n, best = np.zeros(len(counts), dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
        n[counts["at"].to_numpy()], best[counts["at"].to_numpy()] = counts["count"].to_numpy(), counts["best"].to_numpy()
        at, times = np.asarray(row["at"], dtype=np.int64), np.asarray(row["times"], dtype=np.int64)
        upto = np.asarray(row["upto"], dtype=np.int64)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[upto], prepend=0)
        ids = pd.Series(np.asarray(row["doc_id"]), dtype="Int64").mask(np.asarray(row["bare"], dtype=bool))
        return pd.DataFrame({"doc_id": ids, **{c: np.asarray(row[c]) for c in COUNTS}, "n_best": sums(times * best[at]), "count_sum": sums(times * n[at]), "groups_sha256": list(row["groups_sha256"])})
    per_doc = spark.read.parquet(path).drop("pair", "docs").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(
        settle, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    pairs = counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "count", "best")
    return per_doc, pairs


@query("op12_token_align")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]
