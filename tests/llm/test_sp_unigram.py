import hashlib
import random

from pyspark.sql import functions as F

from offerlake.llm import sp_unigram as S

BUILT = S.build(S.read_vocabulary())
VOCABULARY = S.read_vocabulary()
SCORE = {i: s for i, s in VOCABULARY["pieces"].values()}


def slow(text):
    """The best score over all ways to cut a text, characters without a piece costing the unknown score."""
    raw = (" " + text).replace(" ", "▁")
    best = [0.0] + [-float("inf")] * len(raw)
    for end in range(1, len(raw) + 1):
        for start in range(max(0, end - 20), end):
            piece = raw[start:end]
            if piece in VOCABULARY["pieces"]:
                best[end] = max(best[end], best[start] + VOCABULARY["pieces"][piece][1])
        if raw[end - 1] not in VOCABULARY["pieces"]:
            best[end] = max(best[end], best[end - 1] + BUILT["unknown"])
    return best[-1]


def score(ids, text):
    unknown = sum(c not in VOCABULARY["pieces"] for c in text.replace(" ", "▁"))
    return sum(SCORE.get(i, 0.0) for i in ids) + unknown * BUILT["unknown"]


def test_the_trie_holds_the_pieces_and_nothing_else():
    base, check, value = BUILT["base"], BUILT["check"], BUILT["value"]

    def look(word):
        state = 0
        for b in word:
            to = base[state] + b
            if check[to] != state:
                return -1
            state = to
        return value[state]
    words = [p.encode().replace(S.MARK_BYTES, S.SPACE) for p in VOCABULARY["pieces"]]
    assert all(look(w) == n for n, w in enumerate(words))
    known = set(words)
    assert all(look(w + b"\xe2q") == -1 or w + b"\xe2q" in known for w in words[:3000])


def test_best_score_and_round_trip():
    rnd = random.Random(11)
    letters = "etaoin shrdlu  \n\té漢🤖ñ0.,"
    encoder = S.Encoder(BUILT, remembered=50)
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    texts += ["the quick brown fox", "   ", " a", "a ", "\n", "x" * 3000, "한국어 텍스트"]
    for t in texts:
        ids = encoder.encode(t).tolist()
        assert encoder.decode(ids) == t
        assert score(ids, t) == slow(t), t
    for t in ["▁", "a▁b ▁ c", "\x00\x7f", "é" * 100]:
        assert encoder.decode(encoder.encode(t).tolist()) == t


def test_words_as_the_library_cuts_them():
    """The library's own n-best search with unigram scores over the same pieces, on words without ties."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    with open(S.VOCABULARY, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    encoder = S.Encoder(BUILT)
    for t in ["the", "Schule", "thnterble", "quality", "niño", "eauxment", "understanding", "worthless"]:
        assert sp.nbest_encode_as_ids(t, 2)[0] == encoder.encode(t).tolist()


def test_tables(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None), (3, ""), (1, "a text"), (4, "word " * 50000)], "doc_id bigint, text string").withColumn("decoded", F.lit("x"))
    got = S.decode(S.encode(docs)).collect()
    assert [r.decoded for r in got] == ["a text", "", "", "a text", "word " * 50000]
    assert [len(r.token_ids) for r in got[1:3]] == [0, 0]
    checked = S.encode_and_check(docs).collect()
    assert [r.token_ids for r in checked] == [r.token_ids for r in got] and all(r.round_trip for r in checked)
    assert [r.decoded_sha256 for r in checked] == [hashlib.sha256(r.decoded.encode()).hexdigest() for r in got]
    assert S.encode_and_check(docs.limit(0)).collect() == []
    assert S.decode(S.encode(docs.limit(0))).collect() == []
    assert S.decode(spark.createDataFrame([(None,)], "token_ids array<int>")).first().decoded == ""
