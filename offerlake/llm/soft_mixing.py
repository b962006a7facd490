"""Mixing by soft membership: document rates that bring expected domain totals to their targets.

A naive Bayes classifier, learned from a labelled table, gives every document a probability for each domain from binned statistics of
its text and from marker words of a domain. The expected tokens of a domain are the sum of rate x tokens x probability. Nonnegative
rates are then fitted by projected-gradient least squares from rate 1: in every round the totals are summed over all documents, and each
rate moves by the same small vector (one number a domain) times its probabilities and stops at zero. The step is scaled by the domains'
second moments over the documents that are not at zero; where that does not lower the misfit well, the plain gradient's step is taken. The driver only ever holds numbers by
domain. A document's rate is the outcome of the rounds' moves for its probabilities, so it is an expression of them, and the
table of tokens and probabilities is written to the shared folder once.

Everything runs as DataFrame functions. The classifier learns from at most `max_rows` labelled rows (drawn by a hash of the id), whose
ids are few by that bound and are sent to the documents.

Defined results: null text counts as empty (no tokens; its rate is fitted but moves no total); with no usable label every domain is as
likely; a domain without tokens cannot be raised and is left out of the fit; repeated rows have the same rate and copies; an empty table
gives no rows; columns named like those made here are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.functions.amounts import bind
from offerlake.session import cut

from .catalog import query, table
from .divergence_rules import SYMBOLS, taken, total

# Where the bins of a statistic end, in the order in which `statistics` works them out; one more bin is above the last.
BINS = {
    "upper": [0.01, 0.03, 0.06, 0.12, 0.3, 0.6], "symbols": [0.0, 0.01, 0.03, 0.08, 0.15], "shouts": [0.0, 0.005, 0.02, 0.06], "distinct": [0.1, 0.3, 0.5, 0.7, 0.85, 0.95],
    "word_length": [2.0, 3.5, 4.5, 5.5, 7.0, 9.0], "size": [10.0, 30.0, 60.0, 120.0, 250.0, 500.0, 1000.0, 3000.0],
}


def tokens(text: Column) -> Column:
    """Lower-case runs of characters that are neither blank nor a mark that ends a sentence or part of one."""
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D.,;:!?]+"), "")


def statistics(text: Column, w: Column) -> Column:
    """The bins of a text, one for each of BINS."""
    n, chars = F.greatest(F.size(w), F.lit(1)).cast("double"), F.greatest(F.length(text), F.lit(1)).cast("double")
    # the text without small letters, digits, blanks and endings is short, and looked at three times
    marks_of = bind(F.regexp_replace(text, r"[a-z\u00df-\u00ff0-9 \t-\r.,;:]+", ""), lambda rest: F.struct(
        taken(rest, "[A-Z\u00c0-\u00de]+").alias("upper"), taken(rest, SYMBOLS).alias("symbols"), (F.length(rest) - F.length(F.replace(rest, F.lit("!"), F.lit("")))).alias("shouts")))
    values = bind(marks_of, lambda m: F.array(m["upper"] / chars, m["symbols"] / chars, m["shouts"] / chars, F.size(F.array_distinct(w)) / n, chars / n - 1, F.size(w).cast("double")))
    above = lambda edges, value: F.size(F.filter(F.lit(edges), lambda e: value > e))
    # the values are bound first: a lambda works its outer expressions out again for each element
    return bind(values, lambda vs: F.array(*[above(edges, F.get(vs, F.lit(i))) for i, edges in enumerate(BINS.values())]))


def marks(w: Column, markers: list[list[str]]) -> Column:
    """For each domain: whether the text has none, one, or more of its marker words. All are looked up in one pass."""
    every = sorted({x for m in markers for x in m})
    if not every:
        return F.array(*[F.lit(0) for _ in markers])
    hits = lambda found, known: F.least(F.size(F.filter(found, lambda x: x.isin(known))), F.lit(2)) if known else F.lit(0)
    return bind(F.array_intersect(w, F.lit(every)), lambda found: F.array(*[hits(found, m) for m in markers]))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], text: str = "text", doc_id: str = "doc_id", max_rows: int = 20_000, most_markers: int = 200) -> dict:
    """Log probabilities of the domains and of every bin in each, from `labelled` (doc_id, domain), and the domains' marker words: words in at
    least 5 labelled documents of a domain and 8 times as frequent there as elsewhere."""
    usable = labelled.where(F.col("domain").isin(domains)).select(F.col("doc_id").alias("_id"), F.col("domain").alias("_domain"))
    n = usable.count()
    drawn = usable.where(F.pmod(F.xxhash64("_id", F.lit("mixing")), F.lit(1 << 30)) < min(1.0, max_rows / max(1, n)) * (1 << 30)).limit(max_rows + max_rows // 4)
    rows = cut(docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(drawn), "_id")
               .select("_domain", "_text", tokens(F.col("_text")).alias("_words")))
    sizes = {r["_domain"]: r["count"] for r in rows.groupBy("_domain").count().collect()}
    all_rows = sum(sizes.values())
    model = {"domains": domains, "markers": [[] for _ in domains], "prior": [math.log((sizes.get(d, 0) + 1) / (all_rows + len(domains))) for d in domains]}
    said = rows.select("_domain", F.explode(F.array_distinct("_words")).alias("word"))
    each = said.groupBy("word").agg(*[F.sum(F.when(F.col("_domain") == d, 1).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)])
    each = cut(each.where(sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0)) >= 5))
    for i, d in enumerate(domains):
        inside, rest = max(1, sizes.get(d, 0)), max(1, all_rows - sizes.get(d, 0))
        others = sum((F.col(f"n{j}") for j in range(len(domains)) if j != i), F.lit(0))
        found = each.where((F.col(f"n{i}") >= 5) & (F.col(f"n{i}") / inside >= 8.0 * (others + 0.5) / rest)).orderBy(F.desc(f"n{i}"), "word").limit(most_markers).collect()
        model["markers"][i] = [r.word for r in found]
    seen = rows.select("_domain", F.posexplode(F.concat(statistics(F.col("_text"), F.col("_words")), marks(F.col("_words"), model["markers"])))).groupBy("_domain", "pos", "col").count().collect()
    counts = {(r["_domain"], r["pos"], r["col"]): r["count"] for r in seen}
    widths = [len(e) + 1 for e in BINS.values()] + [3] * len(domains)
    model["bins"] = [[[math.log((counts.get((d, f, b), 0) + 0.5) / (sizes.get(d, 0) + 0.5 * width)) for d in domains] for b in range(width)] for f, width in enumerate(widths)]
    return model


def posteriors(text: Column, w: Column, model: dict) -> Column:
    """An array with the probability of every domain."""
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    tables = F.array(*[F.array(*[numbers(b) for b in f]) for f in model["bins"]])
    bins = F.concat(statistics(text, w), marks(w, model["markers"]))
    logs = bind(bins, lambda bs: F.reduce(F.transform(bs, lambda b, f: F.get(F.get(tables, f), b)), numbers(model["prior"]), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)))
    odds = bind(logs, lambda ls: bind(F.array_max(ls), lambda top: F.transform(ls, lambda x: F.exp(x - top))))
    return bind(odds, lambda xs: bind(total(xs), lambda s: F.transform(xs, lambda x: x / s)))


def with_posteriors(docs: DataFrame, model: dict, text: str = "text", moves: list[list[float]] | None = None) -> DataFrame:
    """`docs` with `n_tokens` and the probabilities `_p`; given the moves of a fit, also with `rate`. All of a text is worked out in one
    bound expression, since a lambda would work out again for each element what it finds outside."""
    t = F.coalesce(F.col(text), F.lit(""))
    rate = lambda p: [rate_of(p, moves).alias("rate")] if moves is not None else []
    both = bind(tokens(t), lambda w: bind(posteriors(t, w, model), lambda p: F.struct(F.size(w).cast("bigint").alias("n_tokens"), p.alias("_p"), *rate(p))))
    return docs.withColumn("_m", both).select("*", "_m.*").drop("_m")


# ---- the fit -----------------------------------------------------------------------------------------------------------------------

def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small symmetric system, with a little added to the diagonal so that it has one."""
    n = len(right)
    ridge = 1e-9 * (1 + max(matrix[i][i] for i in range(n)))
    rows = [[*(matrix[i][j] + (ridge if i == j else 0) for j in range(n)), right[i]] for i in range(n)]
    for i in range(n):
        top = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for k in range(n):
            if k != i:
                by = rows[k][i] / rows[i][i]
                rows[k] = [a - by * b for a, b in zip(rows[k], rows[i])]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def rate_of(p: Column, moves: list[list[float]]) -> Column:
    """The rate that the rounds' moves bring a document with these probabilities to."""
    if not moves:
        return F.lit(1.0)
    given = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in moves])
    return F.reduce(given, F.lit(1.0), lambda rate, m: F.greatest(F.lit(0.0), rate - total(F.zip_with(m, p, lambda a, b: a * b))))


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float], budget: float | None = None, anchor: str | None = None, rounds: int = 40, close: float = 1e-6) -> tuple[list[list[float]], dict]:
    """The moves of the rounds for `members` (with `n_tokens` and the probabilities `_p`), and what was reached. The targets are the weights'
    shares of `budget`: by default of all tokens, or, with an `anchor`, of as many as leave that domain's total as it is. Every round reads
    `members` once, so they should be written down before."""
    d = len(domains)
    p = lambda i: F.get("_p", F.lit(i))

    def sums(moves: list[list[float]]):
        return members.withColumn("_rate", rate_of(F.col("_p"), moves)).agg(
            F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all"),
            *[F.coalesce(F.sum(F.col("n_tokens") * F.col("_rate") * p(i)), F.lit(0.0)).alias(f"t{i}") for i in range(d)],
            *[F.coalesce(F.sum(F.when(F.col("_rate") > 0, F.col("n_tokens") * p(i) * p(j))), F.lit(0.0)).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]).first()

    now = sums([])
    whole = float(now["all"]) or 1.0
    share = sum(weights.get(x, 0.0) for x in domains) or 1.0
    if anchor is not None:
        budget = now[f"t{domains.index(anchor)}"] * share / weights[anchor]
    target = [weights.get(x, 0.0) / share * (whole if budget is None else budget) for x in domains]
    live = [i for i in range(d) if now[f"t{i}"] > 1e-9 * whole]
    misfit = lambda s: [(s[f"t{i}"] - target[i]) / whole for i in live]
    wrong = lambda s: sum(x * x for x in misfit(s))
    moves, done = [], 0
    while done < rounds and live and max(map(abs, misfit(now))) > close:
        moment = [[now[f"m{min(i, j)}_{max(i, j)}"] / whole for j in live] for i in live]
        step = solve(moment, misfit(now))
        # the scaled step, half of it, and the plain gradient's step, which never raises the misfit
        for by in (1.0, 0.5, None):
            move = [0.0] * d
            for k, i in enumerate(live):
                move[i] = by * step[k] if by else misfit(now)[k] / max(1e-12, sum(moment[j][j] for j in range(len(live))))
            then = sums([*moves, move])
            done += 1
            if wrong(then) < wrong(now) * (0.9 if by else 1):
                break
        if wrong(then) >= wrong(now) * (1 - 1e-9):
            break
        moves, now = [*moves, move], then
    return moves, {"rounds": done, "target": dict(zip(domains, target)), "reached": {x: now[f"t{i}"] for i, x in enumerate(domains)}}


def copies(rate: Column, doc_id: Column) -> Column:
    """A whole number whose expectation over ids is the rate: the rate is rounded up for as many ids as its fraction asks."""
    return F.floor(rate + F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 52)) / float(1 << 52)).cast("bigint")


DOMAINS = ["sound", "poor", "toxic"]
WEIGHTS = {"sound": 0.9, "poor": 0.07, "toxic": 0.03}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """toxic where so labelled, else by the quality label; rows without the labels they need are left out."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "sound").when(F.col("quality") == 0, "poor").alias("domain")).where("domain is not null")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, anchor: str | None = "sound", text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, dict]:
    """`docs` with `n_tokens`, `p_<domain>`, `rate` and `copies`, and what was reached."""
    made = {"n_tokens", "rate", "copies", "_p", *(f"p_{x}" for x in DOMAINS)}
    docs = docs.drop(*[c for c in docs.columns if c in made and c not in (text, doc_id)])
    model = learn(docs, labelled_domains(labels), DOMAINS, text, doc_id)
    moves, reached = fit_rates(cut(with_posteriors(docs, model, text).select("n_tokens", "_p")), DOMAINS, weights, anchor=anchor)
    return named(with_posteriors(docs, model, text, moves), doc_id), reached


def named(rated: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return rated.withColumns({**{f"p_{x}": F.get("_p", F.lit(i)) for i, x in enumerate(DOMAINS)}, "copies": copies(F.col("rate"), F.col(doc_id))}).drop("_p")


@query("op9_soft_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, labelled_domains(table(spark, sf_dir, "labels")), DOMAINS)
    members = cut(with_posteriors(docs, model).select("doc_id", "n_tokens", "_p"))
    moves, _ = fit_rates(members, DOMAINS, WEIGHTS, anchor="sound")
    return named(members.withColumn("rate", rate_of(F.col("_p"), moves)))
