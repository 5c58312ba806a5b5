"""Toxicity by weak supervision.

1. Voters: words, word beginnings and word ends whose documents are mostly
   toxic, mined from labelled documents, and a few fixed patterns of writing.
   A voter says "toxic" or stays out; one more voter speaks when all are silent.
2. Label model: the accuracy of every voter and the correlations of their
   votes, by expectation maximisation over the vote patterns of all documents.
   Votes that come together anyway count as less than independent ones.
3. A linear classifier learns the label model's posteriors from the words of
   the documents, and scores every document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.store import stored
from dwellgrid.llm.text import LETTERS, U, bounded_batches, chunks, hashed, mix, row_sums, seeded, words

#: Most labelled rows that voters are mined from, the first by hash.
FIT_ROWS = 20_000
VOTERS = 400
VOCABULARY = 4096
BEGINNINGS = (4, 5, 6)  # bytes
ROUNDS = 6
#: Share of toxic documents among a voter's documents, at least.
PRECISION = 0.95
#: Patterns of writing that vote: share of capitals, and exclamation marks per 100 characters.
PATTERNS = {"capitals": (ord("A"), ord("Z"), 0.4), "exclaims": (ord("!"), ord("!"), 0.02)}
_VOTE, _TOKEN = "votes array<int>", "tokens array<int>"


def _tokens(chunk):
    """(row, hash) of every word and word beginning of a chunk, once per row."""
    w = words(chunk, LETTERS, lower=True)
    rows, hashes = [w.row], [hashed(chunk, w)]
    for n in BEGINNINGS:
        longer = np.flatnonzero(w.end - w.start > n)
        rows.append(w.row[longer])
        hashes.append(mix(chunk.spans(w.start[longer], w.start[longer] + n, w.buf) ^ U(seeded(11, n))))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def one_of_copies(texts: DataFrame) -> DataFrame:
    """Labelled documents (doc_id, text, y) without near copies, whose words would count as so many witnesses.

    Documents that share the least hash of their three-word windows, under
    either of two orders, are taken as copies; the smallest id stays.
    """
    orders = (U(seeded(21)), U(seeded(22)))

    def run(batches):
        for batch in batches:
            at = 0
            for c in chunks(batch.column(1)):
                w = words(c, LETTERS, lower=True)
                g, place = w.grams(hashed(c, w), 3)
                edges = np.searchsorted(w.row[place], np.arange(c.n + 1))
                whole = c.spans(c.offs[:-1], c.offs[1:])
                keys = []
                for x in orders:
                    k = mix(whole ^ x)
                    full = np.flatnonzero(np.diff(edges))
                    if len(full):
                        k[full] = np.minimum.reduceat(mix(g ^ x), edges[full])
                    keys.append(pa.array(k.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, c.n), *keys], names=["doc_id", "k1", "k2"])
                at += c.n

    kept = stored(texts.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long"), "toxic-keys")
    for k in ("k1", "k2"):
        kept = kept.groupBy(k).agg(F.min(F.struct("doc_id", "k1", "k2")).alias("x")).select("x.*")
    return texts.join(kept.select("doc_id").distinct(), "doc_id")


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, toxic, clean): labelled documents (text, y) with each token."""

    def run(batches):
        for batch in batches:
            y = np.asarray(batch.column(1))
            for c in chunks(batch.column(0)):
                row, h = _tokens(c)
                token, at = np.unique(h, return_inverse=True)
                bad = y[c.first + row] == 1
                toxic = np.bincount(at.reshape(-1), weights=bad, minlength=len(token)).astype(np.int64)
                n = np.bincount(at.reshape(-1), minlength=len(token))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(toxic), pa.array(n - toxic)], names=["token", "toxic", "clean"])

    return texts.select("text", "y").mapInArrow(run, "token long, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def mine(counts: DataFrame, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """(voters, vocabulary): tokens that speak for toxic text, and tokens that tell the classes apart."""
    if not toxic or not clean:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, base = F.col("toxic") + F.col("clean"), toxic / (toxic + clean)
    share = F.col("toxic") / n
    part = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
    # Chernoff bound: a token of the base rate is this far from it with a chance of at most exp(-told)
    told = n * (part(share, F.lit(base)) + part(1 - share, F.lit(1 - base)))
    known = counts.where("toxic + clean >= 3").withColumn("share", share).withColumn("told", told)
    chance = math.log(max(2, known.count()))  # so that one token of all is taken by chance
    voters = known.where((F.col("share") >= PRECISION) & (F.col("told") > chance)).orderBy(F.desc("told"), "token").limit(VOTERS)
    vocabulary = known.where("told > 3").orderBy(F.desc("told"), "token").limit(VOCABULARY)
    take = lambda df: np.array([r["token"] for r in df.select("token").collect()], np.int64)  # noqa: E731  of fixed length
    return take(voters), take(vocabulary)


def voted(docs: DataFrame, voters: np.ndarray, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, votes and vocabulary tokens of every row of ``docs``, from the whole text."""
    bounded_batches(docs.sparkSession)
    n_voters = len(voters)
    tokens = np.unique(np.concatenate([voters, vocabulary]).view(U))
    as_voter, as_token = np.full(len(tokens) + 1, -1), np.full(len(tokens) + 1, -1)
    as_voter[np.searchsorted(tokens, voters.view(U))] = np.arange(n_voters)
    as_token[np.searchsorted(tokens, vocabulary.view(U))] = np.arange(len(vocabulary))
    bits = np.zeros(1 << 20, bool)
    bits[(tokens & U((1 << 20) - 1)).astype(np.int64)] = True

    def lists(row, value, n):
        order = np.argsort(row, kind="stable")
        edges = np.zeros(n + 1, np.int32)
        np.cumsum(np.bincount(row, minlength=n), out=edges[1:])
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(value[order].astype(np.int32)))

    def run(batches):
        for batch in batches:
            at = 0
            for c in chunks(batch.column(1)):
                row, h = _tokens(c)
                some = bits[(h & U((1 << 20) - 1)).astype(np.int64)]
                row, h = row[some], h[some]
                k = np.searchsorted(tokens, h)
                k[(k == len(tokens)) | (tokens[np.minimum(k, len(tokens) - 1)] != h) if len(tokens) else slice(None)] = len(tokens)
                v, t = as_voter[k], as_token[k]
                size = np.maximum(np.diff(c.offs), 1)
                vr, vv = [row[v >= 0]], [v[v >= 0]]
                for i, (lo, hi, share) in enumerate(PATTERNS.values()):
                    hit = np.flatnonzero(row_sums((c.buf >= lo) & (c.buf <= hi), c.offs) / size >= share)
                    vr.append(hit)
                    vv.append(np.full(len(hit), n_voters + i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, c.n), lists(np.concatenate(vr), np.concatenate(vv), c.n), lists(row[t >= 0], t[t >= 0], c.n)], names=["doc_id", "votes", "tokens"]
                )
                at += c.n

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, f"doc_id long, {_VOTE}, {_TOKEN}")


class LabelModel:
    """Accuracies of unipolar voters and the correlations of their votes."""

    def __init__(self, accuracy: np.ndarray, prior: float, together: np.ndarray | None = None):
        self.accuracy, self.prior = accuracy, prior
        self.together = np.zeros((len(accuracy), len(accuracy)), np.float32) if together is None else together

    def posterior(self, votes: np.ndarray) -> float:
        """Of one vote pattern. Each vote counts as one part of those present that come along with it anyway."""
        base = math.log(self.prior / (1 - self.prior))
        a = np.clip(self.accuracy[votes], 1e-3, 1 - 1e-3)
        weight = 1 / (1 + self.together[np.ix_(votes, votes)].sum(1))
        return 1 / (1 + math.exp(-np.clip(base + float(weight @ (np.log(a / (1 - a)) - base)), -30, 30)))


def with_posterior(df: DataFrame, model: LabelModel) -> DataFrame:
    """``df`` with the posterior ``q`` of its column ``votes``."""
    at, names = df.columns.index("votes"), df.columns
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known: dict[bytes, float] = {}
        for batch in batches:
            q = []
            for x in batch.column(at).to_pylist():
                votes = np.array(x, np.int64)
                if len(votes) > 1:
                    q.append(sent.value.posterior(votes))
                    continue
                key = votes.tobytes()
                if key not in known:
                    known[key] = sent.value.posterior(votes)
                q.append(known[key])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q, pa.float64())], names=[*names, "q"])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "q double"]))


def learn(patterns: DataFrame, start: LabelModel, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over ``patterns`` (votes, n); only sums per voter and per pair of voters come to the driver."""
    model = start
    for step in range(rounds):
        q = with_posterior(patterns, model).withColumn("q", F.col("q") * F.col("n"))
        if step == 0:
            q = stored(q, "toxic-first")
        each = q.select(F.explode("votes").alias("v"), "q", "n").groupBy("v").agg(F.sum("q").alias("q"), F.sum("n").alias("n")).collect()
        accuracy = model.accuracy.copy()
        for r in each:  # voters only ever agree, so half of an accuracy stays with what labels said
            accuracy[r["v"]] = (r["q"] / r["n"] + start.accuracy[r["v"]]) / 2
        together = _together(q, each, len(accuracy)) if step == 0 else model.together
        model = LabelModel(accuracy, start.prior, together)
    return model


def _together(q: DataFrame, each: list, size: int) -> np.ndarray:
    """Positive correlations of the votes of two voters in toxic documents; 1 for a vote that always comes along."""
    total = max(q.agg(F.sum("q")).first()[0] or 0.0, 1e-9)
    mean = np.zeros(size)
    for r in each:
        mean[r["v"]] = min(1.0, r["q"] / total)
    pairs = q.select("q", "votes", F.explode("votes").alias("a")).select("a", "q", F.explode("votes").alias("b")).where("a < b")
    out = np.zeros((size, size), np.float32)
    for r in pairs.groupBy("a", "b").agg(F.sum("q").alias("q")).collect():
        a, b = r["a"], r["b"]
        spread = math.sqrt(max(1e-12, mean[a] * (1 - mean[a]) * mean[b] * (1 - mean[b])))
        out[a, b] = out[b, a] = min(1.0, max(0.0, (r["q"] / total - mean[a] * mean[b]) / spread))
    return out


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by checksum of the id; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, posterior, score and predicted of every row of ``docs``.

    labels: doc_id, toxic (0/1; null left out, repeated labels count as toxic if
    one does). Held-out documents teach nothing. Null and empty texts have no
    token and get the classifier's base score. Without labels of both kinds
    every score is the share of toxic labels (0 without labels). Repeated rows
    are scored each.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    known = stored(known, "toxic-known")
    sample = stored(src.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "text"]), "toxic-sample")
    sample = stored(one_of_copies(sample), "toxic-sample")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    voters, vocabulary = mine(stored(token_counts(sample), "toxic-counts"), toxic, clean)
    rows = stored(voted(src, voters, vocabulary), "toxic-votes").withColumn("held_out", held_out(F.col("doc_id")))
    silent = len(voters) + len(PATTERNS)
    rows = rows.withColumn("votes", F.when(F.size("votes") == 0, F.array(F.lit(silent))).otherwise(F.col("votes")))
    prior = toxic / max(1, toxic + clean)
    if not toxic or not clean:
        out = rows.withColumn("posterior", F.lit(prior)).withColumn("score", F.lit(prior))
        return out.select("doc_id", "held_out", "posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    accuracy = np.full(silent + 1, prior)
    told = rows.where("NOT held_out").join(sample.select("doc_id", "y").distinct(), "doc_id").select("y", F.explode("votes").alias("v"))
    for r in told.groupBy("v").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect():
        accuracy[r["v"]] = (r["y"] + prior) / (r["n"] + 1)
    patterns = stored(rows.groupBy("votes").agg(F.count("*").alias("n")), "toxic-patterns")
    model = learn(patterns, LabelModel(accuracy, prior))
    marked = with_posterior(rows, model).withColumnRenamed("q", "posterior").withColumn("tokens", F.transform("tokens", lambda x: x.cast("string")))
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(max(1, len(vocabulary)))], inputCol="tokens", outputCol="features", minTF=1.0)
    vectors.setBinary(True)
    counted = vectors.transform(marked)
    halves = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight"))))
    teach = counted.where("NOT held_out").select("features", halves.alias("x")).select("features", "x.label", "x.weight").where("weight > 0.001")
    linear = LogisticRegression(weightCol="weight", maxIter=50, regParam=2e-5, standardization=False).fit(teach)
    scored = linear.transform(counted).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "held_out", "posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
