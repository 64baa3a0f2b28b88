"""Single experiments and the method-by-percent comparison."""

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import Encoder, discover_codes
from lacuna.operators import (
    erased_rows,
    exactly_erased_rows,
    filter_numeric,
    forest_impute,
    knn_impute,
    knn_impute_hashed,
    majority,
    nearest_by_step,
    perceptron_impute,
    score_codes,
    score_detail,
    summarize,
    tree_impute,
)
from lacuna.session import scratch, write_and_reread
from lacuna.sources import store_cell, write_detail, write_summary

METHODS = ("knn", "tree", "forest", "perceptron")
# Shares of the target that the comparison erases.
PERCENTS = (10, 20, 30, 40, 50)

#: How rows to erase are chosen: by a threshold on a hash, or an exact number in hash order.
ERASING = {"hash": lambda df, percent, seed, row_id: erased_rows(percent, seed, row_id), "exact": exactly_erased_rows}

_SEARCHES = {"exact": knn_impute, "hashed": knn_impute_hashed}
#: Cells of a comparison that run at the same time, so that short jobs of one fill gaps of another.
CELLS_AT_ONCE = 4

_LEARNERS = {"tree": tree_impute, "forest": forest_impute, "perceptron": perceptron_impute}


@dataclass(frozen=True)
class Report:
    """Scored rows (``line_id, original_value, imputed_value, error``).

    ``detail`` and ``summary`` are plans: reading both imputes twice, unless the
    report is saved first.
    """

    detail: DataFrame

    @property
    def summary(self) -> DataFrame:
        """One row: ``n, total_error, avg_percent_error``."""
        return summarize(self.detail)

    def save(self, path: str) -> "Report":
        """Write ``detail`` and ``summary`` below ``path``; imputing runs once."""
        write_detail(self.detail, f"{path}/detail")
        saved = Report(self.detail.sparkSession.read.schema(self.detail.schema).parquet(f"{path}/detail"))
        write_summary(saved.summary, f"{path}/summary")
        return saved

    def store(self, path: str, method: str, percent: float) -> "Report":
        """Put the report into a store of many, as the cell of ``method`` and ``percent``; an earlier one is replaced."""
        store_cell(self.detail, f"{path}/detail", method, percent)
        cells = self.detail.sparkSession.read.parquet(f"{path}/detail")
        stored = Report(cells.where((F.col("method") == method) & (F.col("percent") == float(percent))).select(self.detail.columns))
        store_cell(stored.summary.coalesce(1), f"{path}/summary", method, percent)
        return stored

    def sql(self, query: str, **tables: DataFrame) -> DataFrame:
        """A query over this report, named ``{detail}`` in it, and other tables by their names in braces.

        The names hold for this query alone, so reports never overwrite each other's.
        """
        return self.detail.sparkSession.sql(query, detail=self.detail, **tables)


def impute(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    method: str,
    *,
    k: int = 10,
    codes: Mapping[str, int] | Encoder | None = None,
    row_id: str = "line_id",
    **options,
) -> DataFrame:
    """``line_id, imputed_value`` by the named method; learners add ``imputed_code``.

    k-NN takes ``search="hashed"`` for the approximate search.
    """
    if method == "knn":
        search = options.pop("search", "exact")
        if search not in _SEARCHES:
            raise ValueError(f"search must be one of {sorted(_SEARCHES)}, not {search!r}")
        return _SEARCHES[search](df, features, target, k, row_id=row_id, **options)
    if method not in _LEARNERS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    codes = codes or discover_codes(df, target)
    return _LEARNERS[method](df, features, target, codes, row_id=row_id, **options)


def run_experiment(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    method: str,
    percent: float = 10,
    *,
    k: int = 10,
    codes: Mapping[str, int] | Encoder | None = None,
    erase: str = "hash",
    erase_seed: int = 42,
    max_classes: int = 1000,
    row_id: str = "line_id",
    **options,
) -> Report:
    """Erase, impute and score; ``df`` carries its row id already.

    ``erase`` is one of ``ERASING``. A target with more than ``max_classes``
    categories is refused by the learners.
    Options are those of the method, such as ``mode``, ``max_depth`` or ``seed``.
    """
    names = [features] if isinstance(features, str) else list(features)
    kept = df.select(row_id, *names, target)
    if method != "knn":
        codes = codes or discover_codes(kept, target, max_classes)
    if erase not in ERASING:
        raise ValueError(f"erase must be one of {sorted(ERASING)}, not {erase!r}")
    erased = ERASING[erase](kept, percent, erase_seed, row_id)
    damaged = kept.withColumn(target, F.when(~erased, F.col(target)))
    imputed = impute(damaged, features, target, method, k=k, codes=codes, row_id=row_id, **options)
    # Only rows without a target can be imputed: the join needs no others.
    truth = kept.where(erased | F.col(target).isNull())
    if method == "knn":
        return Report(score_detail(imputed, truth, target, row_id))
    return Report(score_codes(imputed, truth, target, codes, row_id))


def compare_grid(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    *,
    methods: Iterable[str] = METHODS,
    percents: Iterable[int] = PERCENTS,
    k: int | str = 10,
    codes: Mapping[str, int] | Encoder | None = None,
    erase: str = "hash",
    erase_seed: int = 42,
    max_classes: int = 1000,
    row_id: str = "line_id",
    options: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """``method, percent, n, total_error, avg_percent_error`` for every combination.

    ``k="percent"`` uses the percent as the number of neighbours. ``options``
    holds further settings per method. All methods see the same erased rows. The
    source is read and cleaned once, into a narrow table that every cell reads.
    Rows erased at one percent are erased at every larger one, so k-NN searches
    once for all percents; the learners' cells run ``CELLS_AT_ONCE`` at a time.
    The comparison is worked out when this is called; only its rows, one per
    combination, reach the driver.
    """
    with scratch(df.sparkSession):
        return _compared(df, features, target, list(methods), list(percents), k, codes, erase, erase_seed, max_classes, row_id, options or {})


def _compared(df, features, target, methods, percents, k, codes, erase, erase_seed, max_classes, row_id, options) -> DataFrame:
    names = [features] if isinstance(features, str) else list(features)
    plain = [c for c in names if df.schema[c].dataType.typeName() != "array"]
    df = write_and_reread(filter_numeric(df.select(row_id, *names, target), plain), "grid")
    if codes is None and set(methods) & set(_LEARNERS):
        codes = discover_codes(df, target, max_classes)
    found = {}
    if "knn" in methods and percents and not options.get("knn"):
        found = _knn_cells(df, names, target, percents, k, erase, erase_seed, row_id)

    def cell(at):
        method, percent = at
        report = run_experiment(
            df, features, target, method, percent, k=int(percent) if k == "percent" else k,
            codes=codes, erase=erase, erase_seed=erase_seed, row_id=row_id, **dict(options.get(method, {})),
        )
        return at, tuple(report.summary.first())

    wanted = [(method, percent) for percent in percents for method in methods]
    with ThreadPoolExecutor(CELLS_AT_ONCE) as pool:
        found |= dict(pool.map(cell, [at for at in wanted if at not in found]))
    number = "int" if all(isinstance(p, int) for p in percents) else "double"
    rows = [(method, percent if number == "int" else float(percent), *found[method, percent]) for method, percent in wanted]
    return df.sparkSession.createDataFrame(rows, f"method string, percent {number}, n bigint, total_error bigint, avg_percent_error double")


def _knn_cells(df, features, target, percents, k, erase, erase_seed, row_id) -> dict:
    """Summaries of k-NN at all percents, by one search."""
    steps = sorted(set(percents))
    first = [F.when(ERASING[erase](df, percent, erase_seed, row_id), F.lit(step)) for step, percent in enumerate(steps)]
    rows = df.withColumn("first_step", F.coalesce(*first))
    ks = [max(1, int(percent)) if k == "percent" else k for percent in steps]
    neighbours = nearest_by_step(rows, features, target, "first_step", ks, row_id)
    imputed = neighbours.groupBy("line_id", "step").agg(majority().alias("imputed_value"))
    truth = rows.where(F.col("first_step").isNotNull() | F.col(target).isNull())
    detail = score_detail(imputed, truth, target, row_id, ["step"])
    errors = F.count_if(F.col("error") == 1)
    totals = {r["step"]: r for r in detail.groupBy("step").agg(F.count("*").alias("n"), errors.alias("wrong")).collect()}
    summaries = {}
    for step, percent in enumerate(steps):
        n, wrong = (totals[step]["n"], totals[step]["wrong"]) if step in totals else (0, 0)
        summaries["knn", percent] = (n, wrong, wrong * 100.0 / n if n else None)
    return summaries
