"""SentencePiece encoding and decoding with unigram scores.

The pieces and log scores of a vocabulary file are put into a double-array trie over UTF-8 bytes; a text, with a space put before it and
every space turned into the marker U+2581, is cut into the pieces with the greatest sum of scores (Viterbi; of equal sums, the path whose
last piece starts first). A character that no piece covers costs the least score less 10 and becomes its bytes' pieces. Where no piece
has a marker after another character, as is usual, a text is the chain of its words: each distinct word of some texts is cut once, all that are
not remembered together, in steps over all of them.
Decoding puts the pieces' bytes together, turns markers into spaces and takes the space before the text off again.

Defined results: null and empty texts have no tokens and decode to the empty text; a marker in the text itself is taken apart into
bytes, so decoding gives back every text exactly; repeated rows are encoded alike; very long texts are encoded whole, in memory in proportion to their
length, runs without a space of over 128 characters one by one; an empty table gives no rows; other columns are kept, but for those made here.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .catalog import query, table

MARK, MARK_BYTES = "▁", "▁".encode()
SPACE = b"\xfe"      # stands for the marker in the trie: a byte that UTF-8 does not have, so a marker of the text itself meets no piece
WIDTH = [1 if b < 0xC0 or b >= 0xF8 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)]
WIDTHS = np.array(WIDTH)
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read_vocabulary(path: str = VOCABULARY) -> dict:
    """Pieces with their scores, and the ids of the byte pieces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, bytes_at = {}, [sp.unk_id()] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            bytes_at[int(sp.id_to_piece(i)[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[sp.id_to_piece(i)] = (i, sp.get_score(i))
    return {"pieces": pieces, "bytes": bytes_at, "size": sp.get_piece_size()}


def double_array(words: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """(base, check, value): from state s, byte b leads to base[s] + b if check there is s; value is the word's number or -1."""
    trie: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for word, number in words.items():
        at = 0
        for b in word:
            if b not in trie[at]:
                trie[at][b] = len(trie)
                trie.append({})
            at = trie[at][b]
        ends[at] = number
    size = 8 * len(trie) + 4096
    base, check, value = [0] * size, [-1] * size, [-1] * size
    taken, span = bytearray(size), 1024
    view = np.frombuffer(taken, dtype=np.uint8)
    taken[0], free, wide_from, last, todo = 1, 257, 1, 0, [(0, 0)]    # the first free state; where nodes with several children begin to look
    while todo:
        node, state = todo.pop()
        value[state] = ends.get(node, -1)
        kids = trie[node]
        if not kids:
            base[state] = -1
            continue
        keys = sorted(kids)
        free = taken.index(0, free)
        b = free - keys[0]
        if len(keys) > 1:
            b = max(b, wide_from)
            while True:
                fits = np.flatnonzero(np.logical_and.reduce([view[b + k:b + k + span] == 0 for k in keys]))
                if len(fits):
                    wide_from = b if fits[0] < span // 2 else b + span // 2
                    b += int(fits[0])
                    break
                b += span
        else:
            while taken[b + keys[0]]:
                b += 1
        base[state] = b
        for k in keys:
            taken[b + k], check[b + k] = 1, state
            todo.append((kids[k], b + k))
        last = max(last, b + keys[-1])
    end = last + 257
    return [last + 1 if x < 0 else x for x in base[:end]], check[:end], value[:end]     # a leaf leads to where nothing is


def build(vocabulary: dict) -> dict:
    """What the executors need: the trie, the scores and the pieces' bytes. Its size is bounded by the vocabulary."""
    ids, scores = zip(*vocabulary["pieces"].values())
    base, check, value = double_array({p.encode().replace(MARK_BYTES, SPACE): n for n, p in enumerate(vocabulary["pieces"])})
    table_of = [b""] * vocabulary["size"]
    for p, (i, _) in vocabulary["pieces"].items():
        table_of[i] = p.encode().replace(MARK_BYTES, b" ")
    for b, i in enumerate(vocabulary["bytes"]):
        table_of[i] = bytes([b])
    return {"base": base, "check": check, "value": value, "ids": list(ids), "scores": list(scores), "unknown": min(scores) - 10, "bytes": vocabulary["bytes"], "table": table_of,
            "by_word": not any(MARK in p.lstrip(MARK) for p in vocabulary["pieces"])}


class Encoder:
    """Encodes and decodes with one built vocabulary. The ids of short units are remembered, up to about `remembered` units; the units of some
    texts that are not are cut all at once."""

    def __init__(self, built: dict, remembered: int = 200_000, long: int = 128):
        self.built, self.known, self.remembered, self.long = built, {}, remembered, long
        self.unit = re.compile(r" *[^ ]+| +" if built["by_word"] else r"(?s).+")
        self.base, self.check, self.value, self.ids = (np.array(built[k], dtype=np.int32) for k in ("base", "check", "value", "ids"))
        self.scores = np.array(built["scores"], dtype=np.float64)

    def cut(self, unit: str) -> bytes:
        """The ids, as int32 bytes, of the best way through a unit whose spaces stand for markers."""
        built = self.built
        base, check, value, scores, unknown, ids = built["base"], built["check"], built["value"], built["scores"], built["unknown"], built["ids"]
        raw = unit.encode().replace(b" ", SPACE)
        n, start = len(raw), 0
        best, came, piece = [-inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        while start < n:
            here, state, at, end = best[start], 0, start, start + WIDTH[raw[start]]
            while at < n:
                to = base[state] + raw[at]
                if check[to] != state:
                    break
                state = to
                at += 1
                v = value[to]
                if v >= 0:
                    if here + scores[v] > best[at]:
                        best[at], came[at], piece[at] = here + scores[v], start, v
                    if at == end:
                        end = 0         # the character has a piece of its own
            if end and here + unknown > best[end]:
                best[end], came[end], piece[end] = here + unknown, start, -1
            start += WIDTH[raw[start]]
        out, end = array("i"), n
        while end:
            start, v = came[end], piece[end]
            if v >= 0:
                out.append(ids[v])
            else:
                out.extend(built["bytes"][x] for x in reversed(MARK_BYTES if raw[start:end] == SPACE else raw[start:end]))
            end = start
        out.reverse()
        return out.tobytes()

    def cut_all(self, units: list[str]) -> list[bytes]:
        """`cut` of many short units in steps over all of them: first every piece that begins at any character, by walking the trie from all
        characters together; then the best way to each end, the first ends of all units, the second ends, and so on."""
        raws = [u.encode().replace(b" ", SPACE) for u in units]
        lengths = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        flat = np.frombuffer(b"\xff".join(raws) + b"\xff", dtype=np.uint8).astype(np.int32)        # a byte of no piece ends each unit
        lasts = np.cumsum(lengths + 1) - 1
        firsts = lasts - lengths
        begins = np.flatnonzero(((flat < 0x80) | (flat >= 0xC0)) & (flat != 0xFF))
        widths = WIDTHS[flat[begins]]
        start, state, depth, edges, own = begins, np.zeros(len(begins), dtype=np.int32), 0, [], np.zeros(len(flat), dtype=bool)
        while len(start):
            to = self.base[state] + flat[start + depth]
            on = self.check[to] == state
            start, state, depth = start[on], to[on], depth + 1
            v = self.value[state]
            hit = v >= 0
            edges.append((start[hit], start[hit] + depth, v[hit]))
            own[start[hit & (WIDTHS[flat[start]] == depth)]] = True
        bare = ~own[begins]
        edges.append((begins[bare], begins[bare] + widths[bare], np.full(int(bare.sum()), -1, dtype=np.int32)))
        start, end, v = (np.concatenate(x) for x in zip(*edges))
        step = end - np.repeat(firsts, lengths + 1)[end]
        order = np.lexsort((start, end, step))
        start, end, v, step = start[order], end[order], v[order], step[order]
        score = np.where(v >= 0, self.scores[v], self.built["unknown"])
        best, came, piece = np.zeros(len(flat)), np.zeros(len(flat), dtype=np.int64), np.full(len(flat), -1, dtype=np.int32)
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
        for a, b in zip(cuts, cuts[1:]):
            ends, sums = end[a:b], best[start[a:b]] + score[a:b]
            group = np.flatnonzero(np.diff(ends, prepend=-1))
            top = np.maximum.reduceat(sums, group)
            sizes = np.diff(group, append=b - a)
            first = np.minimum.reduceat(np.where(sums == np.repeat(top, sizes), np.arange(b - a), b - a), group)      # of equal sums the first start
            best[ends[group]], came[ends[group]], piece[ends[group]] = top, start[a:b][first], v[a:b][first]
        path, at, floor = np.zeros(len(flat), dtype=bool), lasts, firsts
        while len(at):
            path[at] = True
            at = came[at]
            on = at > floor
            at, floor = at[on], floor[on]
        ends = np.flatnonzero(path)
        v = piece[ends]
        ids = self.ids[v]
        unit = np.searchsorted(lasts, ends)
        if (v < 0).any():
            spelled = [self.built["bytes"][x] if i < 0 else x for e, i, y in zip(ends.tolist(), v.tolist(), ids.tolist())
                       for x in ([y] if i >= 0 else MARK_BYTES if flat[came[e]] == SPACE[0] else flat[came[e]:e].tolist())]
            counts = np.where(v >= 0, 1, np.where(flat[came[ends]] == SPACE[0], len(MARK_BYTES), ends - came[ends]))
            ids, unit = np.array(spelled, dtype=np.int32), np.repeat(unit, counts)
        raw, upto = ids.astype(np.int32).tobytes(), (4 * np.searchsorted(unit, np.arange(len(units) + 1))).tolist()
        return [raw[a:b] for a, b in zip(upto, upto[1:])]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a unit of the texts is cut once."""
        if len(self.known) > self.remembered:
            self.known = {}
        units = [self.unit.findall(" " + t) if t else [] for t in texts]
        new = list(set().union(*units) - self.known.keys())
        short, long = [u for u in new if len(u) <= self.long], [u for u in new if len(u) > self.long]
        for at in range(0, len(short), 1 << 16):
            some = short[at:at + (1 << 16)]
            self.known.update(zip(some, self.cut_all(some)))
        self.known.update((u, self.cut(u)) for u in long)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, us)), dtype=np.int32) for us in units]
        for u in long:
            del self.known[u]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.built["table"].__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with `token_ids`."""
    shared = docs.sparkSession.sparkContext.broadcast(build(read_vocabulary(vocabulary)))

    @pandas_udf("array<int>")
    def cut_up(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for part in parts:
            for at in range(0, max(1, len(part)), 128):
                yield pd.Series(encoder.encode_all(part.iloc[at:at + 128].tolist()), dtype=object)
    return docs.withColumn("token_ids", cut_up(F.col(text)))


def decode(tokens: DataFrame, ids: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """`tokens` with `decoded`, the text of the ids; null ids decode to the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(build(read_vocabulary(vocabulary)))

    @pandas_udf("string")
    def joined(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for part in parts:
            yield pd.Series([encoder.decode([] if x is None else x.tolist()) for x in part], dtype=object)
    return tokens.withColumn("decoded", joined(F.col(ids)))


def encode_and_check(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, at_once: int = 128) -> DataFrame:
    """`docs` with `token_ids`, and of the text they decode to `decoded_sha256` and `round_trip`, whether it is the text. Both ways are gone
    in one pass over the rows, and results leave in small batches, so a worker holds little beside its input."""
    shared = docs.sparkSession.sparkContext.broadcast(build(read_vocabulary(vocabulary)))

    @pandas_udf("token_ids array<int>, decoded_sha256 string, round_trip boolean")
    def both(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)

        def row(given: str | None, ids: np.ndarray) -> tuple:
            decoded = encoder.decode(ids.tolist())
            return ids, hashlib.sha256(decoded.encode()).hexdigest(), decoded == (given or "")
        for part in parts:
            for at in range(0, len(part), at_once):
                some = part.iloc[at:at + at_once].tolist()
                yield pd.DataFrame([row(t, ids) for t, ids in zip(some, encoder.encode_all(some))], columns=["token_ids", "decoded_sha256", "round_trip"])
            if not len(part):
                yield pd.DataFrame({"token_ids": [], "decoded_sha256": [], "round_trip": []})
    return docs.withColumn("_both", both(F.col(text))).select("*", "_both.*").drop("_both")


@query("op6_sentencepiece_unigram")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_and_check(docs).select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", "decoded_sha256", "round_trip")
