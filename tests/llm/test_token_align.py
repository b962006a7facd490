import hashlib
import random
from collections import Counter

import pandas as pd
import pyarrow.parquet as pq
import pytest

from offerlake.llm import token_align as T

SAMPLE = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def slow():
    """Ids of both libraries for whole texts, and the rest by loops over byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(T.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=T.PIECE_BPE)
    letters = T.byte_letters()

    def bytes_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def one(text):
        if not text:
            return [], [], [], []
        raw = (" " + text).encode()
        out = []
        for ids, spell in ((a.encode(" " + text, add_special_tokens=False).ids, bytes_a), (b.encode(text), bytes_b)):
            spans, at = [], 0
            for i in ids:
                spans.append((at, at + len(spell(i)), i))
                at = spans[-1][1]
            if b"".join(map(spell, ids)) != raw:
                return [], [], [], []
            out.append(spans)
        links, groups, mine = [], [], ([], [])
        for x in out[0]:
            links += [(x[2], y[2]) for y in out[1] if max(x[0], y[0]) < min(x[1], y[1])]
        ends = {x[1] for x in out[0]} & {y[1] for y in out[1]}
        i = j = 0
        for e in sorted(ends):
            g = ([], [])
            while i < len(out[0]) and out[0][i][1] <= e:
                g[0].append(out[0][i][2])
                i += 1
            while j < len(out[1]) and out[1][j][1] <= e:
                g[1].append(out[1][j][2])
                j += 1
            groups.append(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])))
        return [x[2] for x in out[0]], [y[2] for y in out[1]], links, groups
    return one


ODD = [None, "", " ", "  ", "a", "a b", "a  b\n\n  c \t d", "x\n  y", "ends in a space ", "\n", "\t\tif x:\n    return 1  # 'tis we've it's\r\n", "naïve Łódź straße", "日本語のテキスト, 漢字", "🤖🤖 robot", "mark ▁ inside",
       "<|endoftext|> and <s> </s> <unk> <0x41>", "a\x1cb\x85c\xa0d", "’s ‘quotes’ — dash", "nul \x00 byte", "12345 3.14 1,000", "e\u0301 combined", "".join(chr(c) for c in range(32, 591))]


def expected(slow, rows):
    seen = [(i, slow(t)) for i, t in rows]
    count = Counter(p for _, x in seen for p in set(x[2]))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return {i: (len(x[0]), len(x[1]), len(x[3]), len(x[2]), sum(count[p] == most[p[0]] for p in x[2]), sum(count[p] for p in x[2]),
                hashlib.sha256(";".join(x[3]).encode()).hexdigest() if x[0] else "") for i, x in seen}, count, most


def test_equal_to_loops_over_byte_ranges(spark, slow):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice(["ab", " ", "  ", "\n", "Ünd", "zz9", ".", "the ", "'ll"]) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    texts += [t[:3000] for t in pq.read_table(SAMPLE).column("text").to_pylist()[:40]]
    rows = list(enumerate(texts)) + [(9000, "twice the same"), (9001, "twice the same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want, count, most = expected(slow, rows)
    for links, size in ((400_000, 4096), (50, 3)):
        per_doc, pairs = T.align_tokenizers(docs, links=links, rows=size)
        got = {r.doc_id: tuple(r)[1:] for r in per_doc.collect()}
        assert got == want
        assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_both_ways_of_encoding_say_the_same(slow):
    aligner = T.Aligner(*T.files(T.BYTE_BPE, T.PIECE_BPE))
    assert aligner.quick is not None
    texts = [t for t in ODD + pq.read_table(SAMPLE).column("text").to_pylist() if not t or len(t) <= 20000]
    for text, (a, b, _, _, groups) in zip(texts, aligner.aligned(texts, 3)):
        if text and a.size:
            assert a.tolist() == aligner.a.encode(" " + text, add_special_tokens=False).ids
    for text, (a, b, _, _, groups) in zip(texts[:60], aligner.aligned(texts[:60], 3)):
        want = slow(text)
        assert (a.tolist(), b.tolist(), groups.decode()) == (want[0], want[1], ";".join(want[3]))


def test_tables_of_all_kinds(spark, slow):
    docs = spark.createDataFrame([(None, "no id", 1), (5, None, 2), (5, "again", 3), (5, "again", 4)], "doc_id bigint, text string, chunk int")
    got = sorted((tuple(r) for r in T.align_tokenizers(docs)[0].collect()), key=str)
    want, _, _ = expected(slow, [("n", "no id"), (5, None), ("x", "again"), ("y", "again")])
    assert got == sorted([(None, *want["n"]), (5, *want[5]), (5, *want["x"]), (5, *want["y"])], key=str)
    assert T.align_tokenizers(docs.limit(0))[0].collect() == []
    whole = T.alignments(docs.where("text = 'no id'")).first()
    assert ";".join(slow("no id")[3]) == whole.groups and [(x.a, x.b) for x in whole.links] == slow("no id")[2]


def test_a_long_text_is_whole(spark, slow):
    text = "word and another line, " * 3000
    got = T.align_tokenizers(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))[0].first()
    ids = slow(text[:230])
    assert got.n_a > 100 * len(ids[0]) and got.n_links == got.n_a + got.n_b - got.n_groups
    assert isinstance(got, tuple) and pd.notna(got.groups_sha256)


def test_few_chunks_to_a_file(spark):
    """A file is read a batch at a time, so the chunks of a task lie in several."""
    import glob

    from offerlake.session import checkpoint_root
    known = set(glob.glob(f"{checkpoint_root(spark)}/aligned-*"))
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id bigint, text string").coalesce(1)
    found, _ = T.align_tokenizers(docs, rows=1)
    assert found.count() == 40
    (path,) = set(glob.glob(f"{checkpoint_root(spark)}/aligned-*")) - known
    files = glob.glob(f"{path}/*.parquet")
    assert len(files) == 5 and all(spark.read.parquet(f).count() == 8 for f in files)
