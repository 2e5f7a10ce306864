"""Marker scores, deconvolution, classification by templates and centroids, and gene-set tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from countspark.functions.adjust import bh_adjust, holm_filter
from countspark.functions.rows import _dense_blocks, dense_array, feature_rows, map_blocks
from countspark.functions.scans import scan
from countspark.functions.special import normal_upper_quantile, quadratic_ratio_tail, t_tail, t_two_sided
from countspark.operators.linear import LinearFit, design_arrays, ebayes_moderate, make_contrasts, variance_prior
from countspark.session import collect_small, keep, new_path, small


def marker_scores(norm: DataFrame, gene_sets: DataFrame, *, value: str) -> DataFrame:
    """Mean log2(x + 1) of the markers of each set per sample; absent cells count as 0, markers without any cell do not count."""
    sets = gene_sets.select("set_id", "feature").distinct()
    present = sets.join(small(norm.select("feature").distinct()), "feature", "left_semi")
    sizes = small(present.groupBy("set_id").agg(F.count(F.lit(1)).alias("_n")))
    sums = norm.join(small(sets), "feature").groupBy("sample", "set_id").agg(F.sum(F.log2(F.col(value) + 1)).alias("_s"))
    return sums.join(sizes, "set_id").select("sample", "set_id", (F.col("_s") / F.col("_n")).alias("score"))


def simplex_fit(gram: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows p ≥ 0 with Σp ≤ 1 that minimise p'Gp − 2p't, and how far each is from optimal; active sets of all rows at once.

    What is left of the sum is one more share, so rows lie on a simplex. Every row keeps its own set of free shares. A step solves all
    rows for their free shares, moves those that would leave the simplex up to its border, and frees in the others the share whose gain is
    steepest. The second result is the largest breach of the optimality conditions (in units of the largest diagonal entry of G), computed
    from the shares alone: gradients of positive shares equal the multiplier of the sum, those of absent shares are not below.
    """
    n, k = targets.shape
    unit = max(float(np.diag(gram).max()), 1e-300)
    h, lin = np.zeros((k + 1, k + 1)), np.zeros((n, k + 1))
    h[:k, :k], lin[:, :k] = gram / unit, targets / unit
    p = np.zeros((n, k + 1))
    p[:, k] = 1.0
    free = p > 0
    live = np.arange(n)
    for _ in range(20 * (k + 1)):
        if not len(live):
            break
        f = free[live]
        system, right = np.zeros((len(live), k + 2, k + 2)), np.zeros((len(live), k + 2))
        system[:, :k + 1, :k + 1] = h * f[:, :, None] * f[:, None, :] + np.eye(k + 1) * ~f[:, :, None]
        system[:, :k + 1, k + 1] = system[:, k + 1, :k + 1] = f
        right[:, :k + 1], right[:, k + 1] = lin[live] * f, 1.0
        solved = _solve_rows(system, right)
        s = np.where(f, solved[:, :k + 1], 0.0)
        out = f & (s < 0)
        stays = ~out.any(axis=1)
        moving = live[~stays]
        if len(moving):
            at, to, blocked = p[moving], s[~stays], out[~stays]
            ratio = np.where(blocked, at / np.where(blocked, at - to, 1.0), np.inf)
            first = ratio.min(axis=1, keepdims=True)
            hit = blocked & (ratio <= first)
            p[moving] = np.where(hit, 0.0, at + first * (to - at))
            free[moving] &= ~hit
        settled = live[stays]
        p[settled] = s[stays]
        gain = np.where(free[settled], np.inf, p[settled] @ h - lin[settled] + solved[stays, k + 1:])
        worst = gain.argmin(axis=1)
        better = gain[np.arange(len(settled)), worst] < -1e-13
        free[settled[better], worst[better]] = True
        live = np.sort(np.concatenate([moving, settled[better]]))
    slope = p @ h - lin
    over = slope - (p * slope).sum(axis=1, keepdims=True)
    breach = np.where(p > 0, np.abs(over), np.maximum(-over, 0)).max(axis=1)
    return p[:, :k], np.maximum.reduce([breach, np.abs(p.sum(axis=1) - 1), -p.min(axis=1)])


def _solve_rows(system: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One symmetric system per row; rows without a unique solution get the one of least norm."""
    try:
        out = np.linalg.solve(system, right[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        out = np.full(right.shape, np.nan)
    bad = ~(np.abs((system @ out[:, :, None])[:, :, 0] - right).max(axis=1) < 1e-10)
    if bad.any():
        out[bad] = (np.linalg.pinv(system[bad], hermitian=True) @ right[bad][:, :, None])[:, :, 0]
    return out


def deconvolve_fractions(tpm: DataFrame, profile: DataFrame, *, value: str = "tpm", other: bool = True) -> DataFrame:
    """``(sample, cell_type, fraction, residual)``: cell-type fractions from a reference profile ``(cell_type, feature, value[, weight[, mrna]])``.

    Sample and profile are scaled to shares over the signature features. One aggregate gives the normal equations (a short row
    per sample); the constrained problem is then solved for whole batches of samples. ``other`` is what the profile leaves;
    ``residual`` is the breach of the optimality conditions, which rounding alone leaves.
    """
    cols = set(profile.columns)
    weight = F.col("weight") if "weight" in cols else F.lit(1.0)
    mrna = F.col("mrna") if "mrna" in cols else F.lit(1.0)
    sig = keep(profile.select("cell_type", "feature", F.col("value").cast("double").alias("r"), weight.cast("double").alias("w"), mrna.cast("double").alias("mrna")))
    sig = sig.join(small(sig.groupBy("cell_type").agg(F.sum("r").alias("_all"))), "cell_type").select("cell_type", "feature", (F.col("r") / F.col("_all")).alias("r"), "w", "mrna")
    cells = collect_small(sig)
    types = sorted({r["cell_type"] for r in cells})
    feats = sorted({r["feature"] for r in cells})
    at, row = {c: i for i, c in enumerate(types)}, {f: i for i, f in enumerate(feats)}
    ref, wts, per_cell = np.zeros((len(feats), len(types))), np.ones(len(feats)), np.ones(len(types))
    for r in cells:
        ref[row[r["feature"]], at[r["cell_type"]]] = r["r"]
        wts[row[r["feature"]]] = r["w"]
        per_cell[at[r["cell_type"]]] = r["mrna"]
    gram = ref.T @ (wts[:, None] * ref)
    x = tpm.select("feature", "sample", F.col(value).alias("x"))
    totals = small(x.join(small(sig.select("feature").distinct()), "feature", "left_semi").groupBy("sample").agg(F.sum("x").alias("_all")))
    dots = x.join(small(sig), "feature").groupBy("sample", "cell_type").agg(F.sum(F.col("w") * F.col("r") * F.col("x")).alias("d"))
    side = dots.join(totals, "sample").groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("cell_type", F.try_divide("d", "_all").alias("d")))).alias("m"))
    vectors = side.select("sample", F.array(*[F.coalesce(F.col("m")[t], F.lit(0.0)) for t in types]).alias("t"))
    kind = tpm.schema["sample"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            p, residual = simplex_fit(gram, np.vstack(pdf["t"].to_numpy()))
            rest = np.clip(1 - p.sum(axis=1, keepdims=True), 0, None) if other else np.zeros((len(p), 1))
            shares = np.hstack([p / per_cell, rest])
            shares = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"sample": np.repeat(pdf["sample"].to_numpy(), len(types) + 1), "cell_type": (types + ["other"]) * len(pdf), "fraction": shares.reshape(-1), "residual": np.repeat(residual, len(types) + 1)})

    out = vectors.mapInPandas(run, f"sample {kind}, cell_type string, fraction double, residual double")
    return out if other else out.where("cell_type <> 'other'")


def fraction_long(wide: DataFrame, *, id_col: str = "cell_type") -> DataFrame:
    """``(sample, cell_type, fraction)`` from one column per sample."""
    names = [c for c in wide.columns if c != id_col]
    cells = wide.select(F.col(id_col).alias("cell_type"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return cells.unpivot(["cell_type"], [f"`{c}`" for c in names], "sample", "fraction")


#: Random feature sets that a task holds at a time.
NULL_SETS = 100


def template_distances(norm: DataFrame, templates: DataFrame, *, value: str) -> DataFrame:
    """Cosine distance of each sample to each 0/1 class template over the union of the template features."""
    members = templates.select("class", "feature").distinct()
    sizes = small(members.groupBy("class").agg(F.count(F.lit(1)).alias("_m")))
    union = small(members.select("feature").distinct())
    norms = small(norm.join(union, "feature", "left_semi").groupBy("sample").agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_x")))
    dots = norm.join(small(members), "feature").groupBy("sample", "class").agg(F.sum(value).alias("_d"))
    cos = F.try_divide(F.col("_d"), F.sqrt(F.col("_m").cast("double")) * F.col("_x"))
    return dots.join(sizes, "class").join(norms, "sample").select("sample", "class", F.sqrt((1 - cos) / 2).alias("distance"))


def nearest_template(norm: DataFrame, templates: DataFrame, *, value: str, n_perm: int = 1000, seed: int = 1, max_fdr: float | None = None) -> DataFrame:
    """Nearest class per sample with its distance, a permutation p-value and FDR; above ``max_fdr`` there is no prediction.

    The null distances use ``n_perm`` seeded random feature sets of the template's size, the same for all samples, so a batch
    of samples is compared with many of them in one matrix product. Tasks draw the sets from the seed, ``NULL_SETS`` at a time.
    """
    members = collect_small(templates.select("class", "feature").distinct())
    feats, classes = sorted({r["feature"] for r in members}), sorted({r["class"] for r in members})
    size = {c: sum(r["class"] == c for r in members) for c in classes}
    own = np.zeros((len(feats), len(classes)))
    at = {f: i for i, f in enumerate(feats)}
    for r in members:
        own[at[r["feature"]], classes.index(r["class"])] = 1
    sizes = np.array([size[c] for c in classes], dtype=float)
    swapped = norm.select(F.col("sample").alias("feature"), F.col("feature").alias("sample"), value)
    spark_feats = templates.select(F.col("feature").alias("sample")).distinct()
    rows = feature_rows(swapped, value, spark_feats, feats)

    def run(x, _):
        length = np.sqrt((x * x).sum(axis=1))
        safe = np.where(length > 0, length, 1)
        cos = x @ own / np.sqrt(sizes) / safe[:, None]
        best = cos.argmax(axis=1)
        lead = cos[np.arange(len(x)), best]
        above = np.zeros(len(x))
        for at in range(0, n_perm, NULL_SETS):
            n = min(NULL_SETS, n_perm - at)
            order = np.argsort(np.random.default_rng([seed, at]).random((n, len(feats))), axis=1)
            for m in np.unique(sizes[best]).astype(int):
                rows_ = np.flatnonzero(sizes[best] == m)
                pick = np.zeros((len(feats), n))
                pick[order[:, :m].T, np.arange(n)[None, :]] = 1
                above[rows_] += (x[rows_] @ pick / np.sqrt(m) / safe[rows_, None] >= lead[rows_, None] - 1e-12).sum(axis=1)
        p = (1 + above) / (n_perm + 1)
        return {"prediction": [classes[i] for i in best], "distance": np.sqrt(np.maximum(1 - lead, 0) / 2), "p_value": p}

    kind = templates.schema["class"].dataType.simpleString()
    scored = map_blocks(rows, len(feats), run, f"prediction {kind}, distance double, p_value double").withColumnRenamed("feature", "sample")
    out = bh_adjust(keep(scored), "p_value", by=[], key="sample", out="fdr")
    return out if max_fdr is None else out.withColumn("prediction", F.when(F.col("fdr") <= max_fdr, F.col("prediction")))


def nearest_centroid(norm: DataFrame, centroids: DataFrame, *, value: str) -> DataFrame:
    """Class whose centroid correlates best with the sample over their common features (dense input)."""
    side = centroids.select("class", "feature", F.col("value").alias("_c"))
    corr = norm.join(small(side), "feature").groupBy("sample", "class").agg(F.corr(value, "_c").alias("corr"))
    return corr.groupBy("sample").agg(F.max(F.struct(F.round("corr", 12).alias("r"), F.col("class").alias("c"))).alias("b")).select(
        "sample", F.col("b.c").alias("prediction"), F.col("b.r").alias("corr"))


def class_centroids(norm: DataFrame, classes: DataFrame, *, value: str) -> DataFrame:
    """Mean of each feature per class (dense input)."""
    return norm.join(small(classes.select("sample", "class")), "sample").groupBy("class", "feature").agg(F.avg(value).alias("value"))


def feature_places(norm: DataFrame) -> tuple[DataFrame, int]:
    """``(feature, idx)`` in the order of the features, 0-based, and their number; the features stay where they are."""
    numbered = keep(scan(norm.select("feature").distinct(), [], [F.col("feature").asc()], number="_i").select("feature", (F.col("_i") - 1).cast("int").alias("idx")))
    return small(numbered), numbered.count()


def sample_vectors(norm: DataFrame, places: DataFrame, n: int, *, value: str) -> DataFrame:
    """One ML vector per sample by the ``n`` features of ``places``; a feature that a sample lacks is 0, features without a place are left out."""
    cells = norm.join(places, "feature").groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("idx", F.col(value).cast("double").alias("x")))).alias("c"))
    dense = cells.select("sample", F.col("c.idx").alias("idx"), F.col("c.x").alias("x")).select("sample", dense_array(n).alias("v"))
    return dense.select("sample", array_to_vector("v").alias("features"))


def rf_classify(train: DataFrame, test: DataFrame, classes: DataFrame, *, value: str, features=None, trees: int = 50, seed: int = 1) -> DataFrame:
    """Random forest trained on labelled samples and applied to others: prediction and its probability.

    The features are those of ``train``; others in ``test`` are left out, and those that ``test`` lacks count as 0.
    """
    if features is not None:
        from countspark.operators.filters import select_feature_list

        train, test = select_feature_list(train, features), select_feature_list(test, features)
    places, n = feature_places(train)
    labelled = keep(sample_vectors(train, places, n, value=value).join(small(classes.select("sample", F.col("class").cast("double").alias("label"))), "sample"))  # every level of the trees reads it
    path = new_path(train.sparkSession)
    RandomForestClassifier(numTrees=trees, seed=seed).fit(labelled).write().save(path)
    model = RandomForestClassificationModel.load(path)  # without the summary of the training, which tasks cannot take along
    scored = model.transform(sample_vectors(test, places, n, value=value))
    return scored.select("sample", F.col("prediction").cast("int").alias("prediction"), F.array_max(vector_to_array("probability")).alias("probability"))


def train_split(samples: DataFrame, *, frac: float = 0.5, seed: int = 1) -> DataFrame:
    """``(sample, in_train)``: exactly ⌊frac·n⌋ samples, chosen by a seeded hash, independent of partitioning."""
    hashed = samples.select("sample").distinct().withColumn("_h", F.xxhash64(F.col("sample").cast("string"), F.lit(seed)))
    ranked = scan(hashed, [], [F.col("_h").asc(), F.col("sample").asc()], number="_i", size="_n")
    return ranked.select("sample", (F.col("_i") <= F.floor(F.col("_n") * frac)).alias("in_train"))


def one_vs_rest(design: DataFrame, coefs: list) -> DataFrame:
    """Contrast of every group against the mean of the others, for a cell-means design."""
    spec = {c: "".join([c, *[f"-{1 / (len(coefs) - 1):.12f}*{o}" for o in coefs if o != c]]) for c in coefs}
    return make_contrasts(design, spec)


def make_templates(de: DataFrame, *, top: int = 50) -> DataFrame:
    """The ``top`` upward features per class by p (group-limited window), from a one-against-rest result table."""
    w = W.partitionBy("contrast").orderBy(F.col("p_value").asc(), F.col("feature").asc())
    up = de.where((F.col("avg_log2fc") > 0) & F.col("p_value").isNotNull())
    return up.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(F.col("contrast").alias("class"), "feature", "rank")


# --- gene-set tests ---------------------------------------------------------------------------------------------------

@F.pandas_udf(T.DoubleType())
def _z_score(t: pd.Series, df: pd.Series) -> pd.Series:
    """Normal score with the same tail probability as a t statistic."""
    tail = np.clip(t_two_sided(t.fillna(0).to_numpy(), df.to_numpy()) / 2, 1e-300, 0.5)
    score = normal_upper_quantile(tail)
    return pd.Series(np.where(t.isna(), np.nan, -np.sign(t) * score))


def _fold_sets(rows: DataFrame, n: int, width: int, score, kind: T.DataType) -> DataFrame:
    """``(set_id, v, m)``: Σ of ``score(block)`` (``width`` numbers) and number of features per set, from rows ``(set_id, idx, x)``.

    A task adds up its features per set and sends its sums on when they fill its memory, cut into rows of ``PLACES`` numbers; these are
    plain aggregates by set and place, so no group grows with the number of tasks. ``score(block)`` is the sum over the features of a block.
    """
    names = [f"c{i}" for i in range(PLACES)]
    parts = -(-width // PLACES)
    schema = T.StructType([T.StructField("set_id", kind), *T.StructType.fromDDL(f"part int, m bigint, {', '.join(f'{c} double' for c in names)}").fields])
    id_type = to_arrow_schema(schema).field("set_id").type

    def run(batches):
        state: dict = {}

        def flush():
            ids = list(state)
            sums = np.zeros((len(ids), parts * PLACES))
            for i, s in enumerate(ids):
                sums[i, :width] = state[s][0]
            m = np.zeros((len(ids), parts), np.int64)
            m[:, 0] = [state[s][1] for s in ids]
            state.clear()
            table = sums.reshape(-1, PLACES)
            of = pa.array(ids, id_type).take(pa.array(np.repeat(np.arange(len(ids)), parts)))
            return pa.RecordBatch.from_arrays([of, pa.array(np.tile(np.arange(parts, dtype=np.int32), len(ids))), pa.array(m.ravel()), *[pa.array(table[:, i]) for i in range(PLACES)]],
                                              ["set_id", "part", "m", *names])

        for batch in batches:
            ids = np.array(batch.column("set_id").to_pylist(), dtype=object)
            for lo, hi, block in _dense_blocks(batch, n):
                _, first, where = np.unique(ids[lo:hi].astype(str), return_index=True, return_inverse=True)
                for k, at in enumerate(first):
                    members = np.flatnonzero(where == k)
                    entry = state.setdefault(ids[lo + at], [np.zeros(width), 0])
                    entry[0] += score(block[members])
                    entry[1] += len(members)
                if len(state) * width > 16_000_000:
                    yield flush()
        if state:
            yield flush()

    sums = rows.select("set_id", "idx", "x").mapInArrow(run, schema).groupBy("set_id", "part").agg(F.sum("m").alias("m"), *[F.sum(c).alias(c) for c in names])
    whole = F.sort_array(F.collect_list(F.struct("part", F.array(*names).alias("a"))))  # ``width`` numbers
    return sums.groupBy("set_id").agg(F.sum("m").alias("m"), whole.alias("w")).select("set_id", F.slice(F.flatten(F.col("w.a")), 1, width).alias("v"), "m")


def camera_test(fit: LinearFit, contrasts: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """Competitive test per set and contrast: set against the rest, variance inflated by the correlation within the set.

    Residual effects of a feature are scaled to mean square 1; per set only their sums over features are needed.
    """
    d = fit.design
    q = np.linalg.qr(d.matrix)[0]
    df, n = d.df, len(d.samples)

    def residuals(y):
        e = y - (y @ q) @ q.T
        return (e / np.sqrt(np.maximum((e * e).sum(axis=1, keepdims=True) / df, 1e-300))).sum(axis=0)

    sets = small(gene_sets.select("set_id", "feature").distinct())
    sums = _fold_sets(fit.rows.join(sets, "feature"), n, n, residuals, gene_sets.schema["set_id"].dataType)
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    inflation = sums.select("set_id", "m", (square / df / F.col("m")).alias("vif"))
    d0, _ = variance_prior(fit.table, df)
    tested = ebayes_moderate(fit, contrasts)
    total = min(d0 + df, float(df) * fit.table.count())
    z = keep(tested.select("feature", "contrast", _z_score("t", F.lit(float(total))).alias("z")))
    overall = small(z.groupBy("contrast").agg(F.count("z").alias("g"), F.avg("z").alias("mean_z"), F.var_samp("z").alias("var_z")))
    inside = z.join(sets, "feature").groupBy("set_id", "contrast").agg(F.avg("z").alias("set_z"))
    g, m = F.col("g"), F.col("m")
    delta = g / (g - m) * (F.col("set_z") - F.col("mean_z"))
    pooled = ((g - 1) * F.col("var_z") - F.pow(F.col("delta"), F.lit(2.0)) * m * (g - m) / g) / (g - 2)
    vif = F.greatest(F.col("vif"), F.lit(1.0))
    out = inside.join(overall, "contrast").join(small(inflation), "set_id").where(F.col("m") < F.col("g")).withColumn("delta", delta)
    out = out.withColumn("stat", F.col("delta") / F.sqrt(pooled * (vif / m + 1 / (g - m))))
    dof = F.least(F.lit(float(df)), (g - 2).cast("double"))
    return out.select("set_id", "contrast", F.col("m").alias("n_features"), ((F.col("vif") - 1) / F.greatest(m - 1, F.lit(1))).alias("correlation"),
                      F.when(F.col("delta") > 0, "up").otherwise("down").alias("direction"), "stat", t_tail("stat", dof).alias("p_value"))


#: Numbers of a row in which sums of sets are sent.
PLACES = 16


def _residual_column(design: DataFrame, null: DataFrame, coef: str) -> tuple[list, np.ndarray]:
    """The tested design column, made orthogonal to the null design."""
    full, base = design_arrays(design), design_arrays(null)
    q = np.linalg.qr(base.matrix)[0]
    column = full.matrix[:, full.coefs.index(coef)]
    return full.samples, column - q @ (q.T @ column)


def _standard(y: np.ndarray) -> np.ndarray:
    x = y - y.mean(axis=1, keepdims=True)
    sd = x.std(axis=1, ddof=1, keepdims=True)
    return np.divide(x, sd, out=np.zeros_like(x), where=sd > 0)


def set_contributions(norm: DataFrame, design: DataFrame, null: DataFrame, *, value: str, coef: str) -> DataFrame:
    """``(feature, contrast, contribution)``: squared product of the standardised feature with the tested residual column."""
    names, r = _residual_column(design, null, coef)
    rows = feature_rows(norm, value, design, names)
    out = map_blocks(rows, len(names), lambda y, _: {"contribution": (_standard(y) @ r) ** 2}, "contribution double")
    return out.withColumn("contrast", F.lit(coef))


def set_score_test(norm: DataFrame, design: DataFrame, null: DataFrame, gene_sets: DataFrame, *, value: str, coef: str, n_perm: int = 0, seed: int = 1) -> DataFrame:
    """Global test per set: Σ of squared products of its standardised features with the tested residual column, and its p-value.

    The statistic is a quadratic form of the residual column with the kernel of the set (samples × samples, Σ over features). With residuals of any
    direction equally likely, its share of the column's length is a ratio of weighted sums of χ² variables, whose weights are the eigenvalues of
    the kernel in the space that the null design leaves; the tail is computed from them, however small. With ``n_perm``
    the p-value comes from so many permutations of the column instead. A task adds up the kernels of its features per set.
    """
    names, r = _residual_column(design, null, coef)
    n = len(names)
    rows = feature_rows(norm, value, design, names)
    members = gene_sets.select("set_id", "feature").distinct()
    rows = rows.join(small(members.select("feature").distinct()), "feature", "left_semi").join(small(members), "feature").select("set_id", "idx", "x")
    kind = gene_sets.schema["set_id"].dataType
    if n_perm:
        def permuted():
            rng = np.random.default_rng(seed)
            return np.column_stack([r, *[rng.permutation(r) for _ in range(n_perm)]])

        sums = _fold_sets(rows, n, n_perm + 1, lambda block: ((_standard(block) @ permuted()) ** 2).sum(axis=0), kind)
        per = sums.select("set_id", F.col("m").alias("n_features"), F.col("v")[0].alias("stat"), F.slice("v", 2, n_perm).alias("_null"))
        above = F.size(F.filter("_null", lambda q: q >= F.col("stat") * (1 - 1e-12)))
        return per.select("set_id", F.lit(coef).alias("contrast"), "n_features", "stat", ((above + 1) / (n_perm + 1)).alias("p_value"))
    i, j = np.triu_indices(n)
    base = design_arrays(null).matrix
    free = np.linalg.svd(base)[0][:, np.linalg.matrix_rank(base):]  # the space orthogonal to the null design

    def kernel(block):
        z = _standard(block)
        return (z.T @ z)[i, j]

    def tails(batches):
        for pdf in batches:
            stats, tail = [], []
            for v in pdf["v"]:
                k = np.zeros((n, n))
                k[i, j] = k[j, i] = v
                stats.append(r @ k @ r)
                tail.append(quadratic_ratio_tail(np.linalg.eigvalsh(free.T @ k @ free), stats[-1] / (r @ r)))
            yield pd.DataFrame({"set_id": pdf["set_id"], "n_features": pdf["m"], "stat": stats, "p_value": tail})

    schema = T.StructType([T.StructField("set_id", kind), *T.StructType.fromDDL("n_features bigint, stat double, p_value double").fields])
    per = _fold_sets(rows, n, len(i), kernel, kind).mapInPandas(tails, schema)
    return per.select("set_id", F.lit(coef).alias("contrast"), "n_features", "stat", "p_value")


def set_gene_ranks(contributions: DataFrame, gene_sets: DataFrame, de: DataFrame) -> DataFrame:
    """Features of each set ranked by contribution, joined to a result table by feature and contrast."""
    members = small(gene_sets.select("set_id", "feature").distinct())
    ranked = scan(contributions.join(members, "feature"), ["set_id", "contrast"], [F.col("contribution").desc(), F.col("feature").asc()], number="set_rank")
    return ranked.join(de, ["feature", "contrast"])


def selected_set_ranks(set_p: DataFrame, contributions: DataFrame, gene_sets: DataFrame, de: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """Sets that pass Holm's correction, ranked per contrast, with the ranks of their features and the result table."""
    chosen = keep(holm_filter(set_p, by=["contrast"], alpha=alpha))
    order = W.partitionBy("contrast").orderBy("adj_p", "p_value", "set_id")  # one row per chosen set
    ranks = small(chosen.withColumn("set_order", F.row_number().over(order)).select("set_id", "contrast", F.col("adj_p").alias("set_adj_p"), "set_order"))
    members = gene_sets.join(ranks.select("set_id").distinct(), "set_id", "left_semi")
    return set_gene_ranks(contributions, members, de).join(ranks, ["set_id", "contrast"])
