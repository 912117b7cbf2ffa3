"""Mixing documents to target weights over soft domain membership.

A classifier fitted on the labelled table gives every document posterior probabilities of the domains. Documents then
get nonnegative rates (expected numbers of copies) such that the expected tokens of each domain match its target, by
least squares with projected gradient steps. A step is known from one number per domain, so only those travel: the
executors work out each document's rate from its posteriors and the few steps so far, and sum tokens by domain.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, same_doc, saved, slices, utf8_parts
from .rolling import mixed, word_bounds, word_values

log = logging.getLogger(__name__)

#: Labelled rows of a domain that the classifier is fitted on; a bound on the sample, chosen by a hash of the id.
MAX_LABELLED = 5_000
#: Hash buckets of the classifier's words.
FEATURES = 1 << 17
#: Tasks of a step of the fit.
SAMPLE_PARTS = 4
#: Iterations and L2 penalty of the fit; stopping early does better on held-out labels than the converged fit.
MAX_STEPS, PENALTY = 40, 1e-4
#: Halvings of a whitened step before plain steps take over.
HALVED = 6
#: Share of all target tokens below which a plain pass counts as standing still.
STILL = 1e-4
#: Documents of the sample, and share of them, that a feature has to occur in; chosen on held-out labels.
MIN_DOCS, MIN_SHARE = 5, 0.001
#: The intercept of a domain without evidence.
NO_EVIDENCE = -30.0


#: Bytes at which the classifier's words end, as blanks; A-Z as a-z.
_PLAIN = bytes(32 if x < 48 or 58 <= x < 64 or 91 <= x < 96 or 123 <= x < 128 else x + 32 if 65 <= x <= 90 else x for x in range(256))
_MARKS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CAPITALS = np.isin(np.arange(256), np.arange(65, 91))
#: Words hashed at once, and bytes of texts in one unit of work; both bound memory, not results.
BLOCK, SLICE = 1 << 15, 1 << 19
#: Steps of each of the three marks of style, which follow the words' buckets.
STEPS = 10
SIZE = FEATURES + 3 * STEPS


def _features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature) pairs of a batch of texts, distinct and in order, and the number of words of each text.

    The features are hash buckets of lower-cased words without marks, and three marks of style: shares of symbols, of
    capitals and of repeated lines, in steps.
    """
    raw, offsets = utf8_parts(text)
    data = raw.tobytes()
    n = len(offsets) - 1
    length = np.diff(offsets)
    plain = np.frombuffer(data.translate(_PLAIN), np.uint8)
    start, end, bounds = word_bounds(plain, offsets)
    keys = []
    of = np.repeat(np.arange(n), np.diff(bounds))
    for at in range(0, len(start), BLOCK):
        own, stop = start[at : at + BLOCK], end[at : at + BLOCK]
        hashes = word_values(plain[own[0] : stop[-1]], own - own[0], stop - own[0])
        keys.append(np.unique(of[at : at + BLOCK] << 18 | (mixed(hashes) % np.uint64(FEATURES)).astype(np.int64)))
    lines = [data[a:b].split(b"\n") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    count = np.fromiter(map(len, lines), np.int64, n)
    again = count - np.fromiter((len(set(x)) for x in lines), np.int64, n)
    for kind, (part, whole, scale) in enumerate(((_within(_MARKS[raw], offsets), length, 40), (_within(_CAPITALS[raw], offsets), length, 20), (again, count, 10))):
        step = np.minimum(STEPS - 1, scale * part // np.maximum(whole, 1))
        keys.append(np.arange(n) << 18 | FEATURES + kind * STEPS + step)
    found = np.unique(np.concatenate(keys))
    _, _, words = word_bounds(raw, offsets)
    return found >> 18, found & 0x3FFFF, np.diff(words)


def _within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def _feature_lists(batches):
    for batch in slices(batches, SLICE):
        doc, feature, _ = _features(batch.column("text"))
        at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(at, feature.astype(np.int32))], names=["label", "present"])


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str, text_col: str, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Weights (domains x features) and intercepts of domain posteriors fitted on ``labels`` (doc_id, domain).

    At most about ``max_labelled`` rows of each domain are used, chosen by a hash of their id; their number bounds the
    broadcast of ids and what is trained on. Features of fewer documents than a
    tenth of the sample, ``MIN_DOCS`` at most, or than its ``MIN_SHARE`` have weight zero. A domain without any labelled document in ``docs`` has no evidence: weights of zero, a posterior close to none.
    """
    number = F.create_map(*[x for n, d in enumerate(domains) for x in (F.lit(d), F.lit(n))])[F.col("domain")]
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), number.cast("double").alias("label")).where("label is not null and label_id is not null")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < len(domains):
        missing = sorted(set(range(len(domains))) - set(map(int, sizes)))
        raise ValueError(f"no labelled rows for {[domains[n] for n in missing]}")
    share = F.create_map(*[x for n, size in sizes.items() for x in (F.lit(n), F.lit(min(1.0, max_labelled / size)))])[F.col("label")]
    chosen = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < share * (1 << 20)).groupBy("label_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "label_id").select("label", "text").mapInArrow(_feature_lists, "label double, present array<int>")
    rows = saved(rows, "labelled")
    weights, base = np.zeros((len(domains), SIZE), np.float32), np.full(len(domains), NO_EVIDENCE)
    # each row stands for as many labelled ones as the sample leaves out, so the posteriors keep the domains' true shares
    used = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(used) < len(domains):
        log.warning("no labelled document of %s is in the corpus", [d for n, d in enumerate(domains) if n not in used])
    found = sorted(map(int, used))
    if len(found) < 2:
        base[found] = 0.0
        return weights, base
    scale = sum(used.values()) / sum(sizes.values())
    weight = F.create_map(*[x for n, count in used.items() for x in (F.lit(n), F.lit(scale * sizes[n] / count))])[F.col("label")]
    place = F.create_map(*[x for at, n in enumerate(found) for x in (F.lit(float(n)), F.lit(float(at)))])[F.col("label")]
    count = sum(used.values())
    enough = max(min(MIN_DOCS, -(-count // 10)), round(MIN_SHARE * count))
    common = rows.select(F.explode("present").alias("feature")).groupBy("feature").count().where(F.col("count") >= enough)
    columns = np.sort(np.array([r["feature"] for r in common.select("feature").collect()], np.int64))  # at most SIZE
    if not len(columns):  # nothing but the domains' shares is known
        base[found] = [np.log(sizes[n]) for n in found]
        return weights, base

    def vector(present):
        at = np.searchsorted(columns, present)
        at = at[columns[np.minimum(at, len(columns) - 1)] == present]
        return Vectors.sparse(len(columns), at.tolist(), np.ones(len(at)))

    rows = rows.select(F.udf(vector, VectorUDT())("present").alias("features"), weight.alias("weight"), place.alias("label"))  # the sample only
    rows = rows.coalesce(SAMPLE_PARTS)  # bounded as the sample is: a step is one stage of few tasks then
    model = LogisticRegression(family="multinomial", maxIter=MAX_STEPS, regParam=PENALTY, weightCol="weight", standardization=False).fit(rows)
    weights[np.ix_(found, columns)] = model.coefficientMatrix.toArray()
    base[found] = model.interceptVector.toArray()
    return weights, base


def posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, rk, n_tokens, p): number of words and domain posteriors of each document."""
    weights, base = model

    def score(batches):
        for batch in slices(batches, SLICE):
            doc, feature, words = _features(batch.column("text"))
            margins = np.stack([np.bincount(doc, own[feature], batch.num_rows) for own in weights], axis=1) + base
            p = np.exp(margins - margins.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            at = np.arange(0, p.size + 1, len(base), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rk"), pa.array(words.astype(np.int64)), pa.ListArray.from_arrays(at, p.ravel())], names=["doc_id", "rk", "n_tokens", "p"]
            )

    return keyed_texts(docs, id_col, text_col).mapInArrow(score, "doc_id long, rk long, n_tokens long, p array<double>")


def _bounds(p: np.ndarray, once: int | None):
    """Least and largest rate of each document. With ``once``, the number of a domain, no rate is above 1 and none of a
    document that this domain leads is below."""
    return (0.0, np.inf) if once is None else ((p.argmax(1) == once).astype(float), 1.0)


def _rates(p: np.ndarray, steps: list[tuple[np.ndarray, float]], once: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps (one number per domain, and the momentum), and the point the next step starts from."""
    low, high = _bounds(p, once)
    rate = ahead = np.ones(len(p))
    for step, momentum in steps:
        new = np.clip(ahead - p @ step, low, high)
        ahead = new + momentum * (new - rate)
        rate = new
    return rate, ahead


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def batch_sums(p: np.ndarray, n: np.ndarray, steps, once: int | None) -> np.ndarray:
    """What a pass sums over documents: tokens by domain after the steps and at the point ahead, and the products of
    domains over documents whose rates can still move."""
    rate, ahead = _rates(p, steps, once)
    low, high = _bounds(p, once)
    free = n * ((rate > low) & (rate < high))
    return np.concatenate([(rate * n) @ p, (ahead * n) @ p, ((p * free[:, None]).T @ p).ravel()])


def descend(totals, goal: np.ndarray, own: np.ndarray, k: int, tolerance: float, once: int | None) -> tuple[list[tuple[np.ndarray, float]], np.ndarray, bool]:
    """Steps towards the goal; ``totals(steps)`` makes a pass over the documents. Returns the steps, the totals that they
    reach and whether these are final.

    A step is the projected gradient of the squared distance with the domains' equations whitened by the products of
    domains over the documents that can still move, so domains that overlap do not hinder each other; it is halved up to
    ``HALVED`` times while it brings no progress. If that does not help, or with ``once``, the goal may be out of reach,
    where whitening would move the solution: steps are plain ones then (each equation divided by its own total, a step of
    1 never overshoots) with momentum, which starts anew whenever the distance grows, until the totals stand still.
    """
    scale = np.where(own > 0, own, 1.0)
    distance = lambda x: ((x - goal) ** 2 / scale).sum()
    near = lambda x: bool((np.abs(x - goal) <= tolerance * np.where(goal > 0, goal, goal.sum() + 1e-9)).all())
    steps: list[tuple[np.ndarray, float]] = []
    reached, ahead, products = np.split(totals(steps), [k, 2 * k])
    pace, before, whitened = 1.0, np.inf, once is None
    while not near(reached):
        if whitened:
            step = np.linalg.pinv(products.reshape(k, k), rcond=1e-9, hermitian=True) @ (reached - goal)
            for halved in range(HALVED + 1):
                tried = np.split(totals([*steps, (step / 2**halved, 0.0)]), [k, 2 * k])
                if distance(tried[0]) < (1 - tolerance) * distance(reached):
                    steps.append((step / 2**halved, 0.0))
                    reached, ahead, products = tried
                    break
            else:
                whitened = False
            continue
        pace = 1.0 if distance(reached) > before else pace
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        steps.append(((ahead - goal) / scale, (pace - 1) / faster))
        before, pace, last = distance(reached), faster, reached
        reached, ahead, _ = np.split(totals(steps), [k, 2 * k])
        if max(np.abs(reached - last).max(), np.abs(ahead - reached).max()) <= STILL * goal.sum():
            return steps, reached, once is not None
    return steps, reached, True


def solve_rates(scored: DataFrame, targets, k: int, tolerance: float = 1e-3, once: int | None = None) -> tuple[DataFrame, list[float], list[float]]:
    """Add rate to ``scored`` (with n_tokens and p): nonnegative rates r that minimise the squared, domain-weighted
    distance of sum(r * n_tokens * p) from the targets. ``targets`` maps the domains' own totals to target totals.

    Every pass sends the steps so far, a few numbers each, and gets sums over domains back. Passes end when every
    domain's total is within ``tolerance`` of its target or, where the targets cannot be reached, with a warning once the
    totals stand still. Also returns the expected totals reached and the targets.

    With ``once``, the number of a domain, rates are at most 1, and 1 for the documents that this domain leads. The
    targets may be out of reach then; passes end once the totals stand still.
    """
    width = 2 * k + k * k

    def totals(steps: list[tuple[np.ndarray, float]]) -> np.ndarray:
        def run(batches):
            out = np.zeros(width)
            for batch in batches:
                out += batch_sums(_matrix(batch.column("p"), k), batch.column("n_tokens").to_numpy(), steps, once)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(out)], names=["entry", "value"])

        rows = scored.select("n_tokens", "p").mapInArrow(run, "entry int, value double")
        out = np.zeros(width)
        for row in rows.groupBy("entry").agg(F.sum("value").alias("value")).collect():
            out[row["entry"]] = row["value"]
        return out

    own = totals([])[:k]
    goal = np.asarray(targets(own), float)
    steps, reached, final = descend(totals, goal, own, k, tolerance, once)
    if not final:
        log.warning("the targets cannot be reached: tokens by domain %s, targets %s after %d steps", reached.tolist(), goal.tolist(), len(steps))

    columns = scored.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema) + ", rate double"

    def apply(batches):
        for batch in batches:
            rate, _ = _rates(_matrix(batch.column("p"), k), steps, once)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(rate)], names=[*columns, "rate"])

    return scored.mapInArrow(apply, ddl), reached.tolist(), goal.tolist()


def mix_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], keep_domain: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, rk (a key that also depends on the text), n_tokens (words), p_<domain> and rate.

    ``labels`` has (doc_id, domain); ``weights`` gives each domain's share of the mixture's tokens. The total is the
    largest that needs no domain more than once or, with ``keep_domain``, the one that keeps all of that domain.

    Null texts have no tokens and get posteriors of an empty text. Repeated rows are documents of their own. Labels
    without a document, of other domains or null are left out; a domain without any label is an error, one whose labelled
    documents are not in the corpus gets posteriors close to none. An empty table gives an empty result. Further columns
    are not read.
    """
    domains = sorted(weights)
    rated, _, _ = _rated(docs, labels, weights, keep_domain, id_col, text_col, max_labelled)
    return rated.select("doc_id", "rk", "n_tokens", *[F.get("p", F.lit(n)).alias(f"p_{d}") for n, d in enumerate(domains)], "rate")


def _rated(docs: DataFrame, labels: DataFrame, weights: dict[str, float], keep_domain: str | None, id_col: str, text_col: str, max_labelled: int = MAX_LABELLED, once: bool = False) -> tuple[DataFrame, list[float], list[float]]:
    """(doc_id, rk, n_tokens, p, rate), the expected totals by domain, and their targets."""
    domains = sorted(weights)
    share = np.array([weights[d] for d in domains]) / sum(weights.values())
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, rk long, n_tokens long, p array<double>, rate double"), [0.0] * len(domains), [0.0] * len(domains)
    model = fit_domains(docs, labels, domains, id_col, text_col, max_labelled)
    scored = saved(posteriors(docs, model, id_col, text_col), "posteriors")

    def targets(own: np.ndarray) -> np.ndarray:
        if keep_domain:
            at = domains.index(keep_domain)
            return share * own[at] / share[at]
        return share * min(o / s for o, s in zip(own, share) if s > 0)

    return solve_rates(scored, targets, len(domains), once=domains.index(keep_domain) if once else None)


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float], keep_domain: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a pass over the mixture takes, with all their columns: each document with its rate as
    probability, by a hash of its id and text.

    A document is taken once at most, so rates are solved for between 0 and 1; documents that ``keep_domain`` leads have
    rate 1 and stay for certain. What then is out of reach shows in the log: tokens by domain wanted, expected and taken.

    Null and empty texts have no tokens, and are judged by the posteriors of an empty text like any other. Rows equal in id
    and text are taken or left together; a null id is an id. An empty table gives an empty one; all columns stay as they
    are, whatever their names.
    """
    rated, reached, goal = _rated(docs, labels, weights, keep_domain, id_col, text_col, once=True)
    chance = F.pmod(F.xxhash64("doc_id", "rk"), F.lit(1 << 20)) / (1 << 20)
    taken = saved(rated.where(F.col("rate") > chance), "taken")
    sums = taken.agg(*[F.sum(F.col("n_tokens") * F.get("p", F.lit(n))) for n in range(len(goal))]).first()
    for domain, wanted, expected, own in zip(sorted(weights), goal, reached, sums):
        report = log.warning if abs((own or 0.0) - wanted) > 0.01 * sum(goal) else log.info
        report("tokens of %s: target %.0f, expected %.0f, taken %.0f", domain, wanted, expected, own or 0.0)
    taken = taken.select("doc_id", "rk").distinct()
    keyed = keyed_texts(docs, id_col, text_col, carry=True)
    return keyed.join(taken, same_doc(keyed, taken), "left_semi").select("row.*")
