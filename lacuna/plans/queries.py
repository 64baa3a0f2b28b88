"""Every operator as a query over the test tables: ``(spark, folder) -> DataFrame``."""

from collections.abc import Callable

from pyspark.ml.classification import DecisionTreeClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import category_of, code_of, discover_codes, fit_encoder, is_number, to_double, to_long, to_text
from lacuna.operators import (
    cast_features,
    distance_to_row,
    erase,
    erase_exact,
    filter_numeric,
    in_training_part,
    knn_impute,
    nearest,
    nearest_hashed,
    node_table,
    perceptron_class,
    places_of,
    plan_training,
    project_attributes,
    tree_class,
    votes,
    walk_nodes,
    weight_table,
)
from lacuna.session import written_path
from lacuna.sources import as_text, load_csv, load_parquet, with_row_id, write_detail

from .experiment import METHODS, PERCENTS, Report, compare_grid, run_experiment

Query = Callable[[SparkSession, str], DataFrame]

K = 10
PERCENT = 10
ORDER_CODES = {"F": 1, "O": 2, "P": 3}
CUSTOMER_FEATURES = ["c_acctbal", "c_nationkey"]
ORDER_FEATURES = ["o_totalprice", "o_custkey", "o_year", "o_month"]
PART_FEATURES = ["p_size", "p_retailprice"]


def _table(spark, folder, name):
    return load_parquet(spark, f"{folder}/{name}.parquet")


def _lineitem(spark, folder):
    """``lineitem`` with an id made of its content: no copy of the table, the same in every job."""
    content = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.unix_date(F.to_date("l_shipdate")))
    return _table(spark, folder, "lineitem").withColumn(
        "line_id", F.conv(F.substring(F.md5(content), 1, 15), 16, 10).cast("bigint")
    )


def _customer(spark, folder):
    return with_row_id(_table(spark, folder, "customer"), "c_custkey")


def _orders(spark, folder):
    orders = with_row_id(_table(spark, folder, "orders"), "o_orderkey")
    return orders.withColumns({"o_year": F.year("o_orderdate"), "o_month": F.month("o_orderdate")})


def _embeddings(spark, folder):
    return with_row_id(_table(spark, folder, "embeddings"), "vec_id")


def _part(spark, folder):
    return with_row_id(_table(spark, folder, "part"), "p_partkey")


def _mixed_text(spark, folder):
    """Event ids written in eight ways, of which some are numbers as text."""
    way, text = F.col("event_id") % 8, F.col("event_id").cast("string")
    written = (
        F.when(way == 0, "?")
        .when(way == 2, F.concat(text, F.lit("e5")))
        .when(way == 3, F.concat(F.lit("."), text))
        .when(way == 4, F.concat(F.lit("-"), text))
        .when(way == 5, F.concat(text, F.lit(".25")))
        .when(way == 6, F.concat(F.lit(" "), text))
        .when(way == 7, F.concat(F.lit("+"), text))
    )
    second = F.when(F.col("event_id") % 5 == 1, "x").when(F.col("event_id") % 5 != 0, F.concat(text, F.lit(".5")))
    return _table(spark, folder, "events").select("event_id", written.alias("v"), second.alias("w"))


# --- sources and projections -------------------------------------------------


def load_as_strings(spark, folder):
    return as_text(_table(spark, folder, "part"))


def load_csv_strings(spark, folder):
    path = written_path(spark, "csv")
    _table(spark, folder, "customer").write.option("header", True).csv(path)
    return load_csv(spark, path)


def row_id(spark, folder):
    return _customer(spark, folder)


def row_id_generated(spark, folder):
    rows = with_row_id(_table(spark, folder, "lineitem").select("l_returnflag"))
    # Ids hardly repeat, so a count before the shuffle would only hold all ids of a split in memory.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "line_id")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("line_id").alias("ids"))


def project(spark, folder):
    return project_attributes(_customer(spark, folder), ["c_nationkey", "c_mktsegment"])


def encode_target(spark, folder):
    orders = erase(_orders(spark, folder), "o_orderstatus", PERCENT)
    return orders.select("o_orderkey", code_of(F.col("o_orderstatus"), {"F": 1, "P": 2}).alias("code"))


def decode_target(spark, folder):
    coded = encode_target(spark, folder)
    return coded.select("o_orderkey", category_of(F.col("code"), {"F": 1, "P": 2}).alias("category"))


# --- predicates and casts ----------------------------------------------------


def is_numeric(spark, folder):
    return _mixed_text(spark, folder).select("event_id", F.coalesce(is_number(F.col("v")), F.lit(False)).alias("ok"))


def clean_numeric(spark, folder):
    clean = cast_features(filter_numeric(_mixed_text(spark, folder), ["v", "w"]), ["v", "w"])
    return clean.select("event_id", "v", "w")


def cast_double(spark, folder):
    text = _mixed_text(spark, folder).where(is_number(F.col("v")))
    return text.select("event_id", to_double(to_text(F.col("v"))).alias("number"))


def cast_long(spark, folder):
    return _mixed_text(spark, folder).select("event_id", to_long(F.col("v")).alias("number"))


# --- missingness -------------------------------------------------------------


def erase_target(spark, folder):
    return erase(_customer(spark, folder), "c_mktsegment", PERCENT).select("line_id", "c_mktsegment")


def erase_exact_target(spark, folder):
    return erase_exact(_customer(spark, folder), "c_mktsegment", PERCENT).select("line_id", "c_mktsegment")


def erase_exact_orders(spark, folder):
    return erase_exact(_orders(spark, folder), "o_orderstatus", 30).select("line_id", "o_orderstatus")


def split_70_30(spark, folder):
    return _customer(spark, folder).select(
        "line_id", F.when(in_training_part(70, 1234), "train").otherwise("test").alias("part")
    )


# --- nearest neighbours ------------------------------------------------------


def _damaged_customer(spark, folder):
    return erase(_customer(spark, folder), "c_mktsegment", PERCENT)


def pairwise_distance(spark, folder):
    damaged = _damaged_customer(spark, folder)
    first = damaged.where("c_mktsegment IS NULL").orderBy("line_id").limit(1)
    return distance_to_row(damaged, CUSTOMER_FEATURES, "c_mktsegment", first)


def pairwise_distance_embeddings(spark, folder):
    damaged = erase(_embeddings(spark, folder), "label", PERCENT)
    first = damaged.where("label IS NULL").orderBy("line_id").limit(1)
    return distance_to_row(damaged, "embedding", "label", first)


def _neighbours(damaged, features, target):
    return nearest(damaged, features, target, K)


def knn_neighbours(spark, folder):
    found = _neighbours(_damaged_customer(spark, folder), CUSTOMER_FEATURES, "c_mktsegment")
    return found.select("line_id", "neighbour_id", "value", "d2", "rank")


def knn_neighbours_embeddings(spark, folder):
    damaged = erase(_embeddings(spark, folder), "label", PERCENT)
    return _neighbours(damaged, "embedding", "label").select("line_id", "neighbour_id", "value", "rank")


def knn_votes(spark, folder):
    return votes(_neighbours(_damaged_customer(spark, folder), CUSTOMER_FEATURES, "c_mktsegment"))


def knn_impute_customer(spark, folder):
    return knn_impute(_damaged_customer(spark, folder), CUSTOMER_FEATURES, "c_mktsegment", K)


def knn_impute_embeddings(spark, folder):
    return knn_impute(erase(_embeddings(spark, folder), "label", PERCENT), "embedding", "label", K)


def knn_impute_orders(spark, folder):
    return knn_impute(erase(_orders(spark, folder), "o_orderstatus", PERCENT), ORDER_FEATURES, "o_orderstatus", K)


def knn_impute_part(spark, folder):
    return knn_impute(erase(_part(spark, folder), "p_type", 50), PART_FEATURES, "p_type", K)


def knn_impute_lineitem(spark, folder):
    lines = _lineitem(spark, folder)
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return knn_impute(erase(lines, "l_returnflag", PERCENT), features, "l_returnflag", K)


def knn_neighbours_hashed(spark, folder):
    """The approximate search; it has no SQL, as what it misses depends on its buckets."""
    damaged = erase(_orders(spark, folder), "o_orderstatus", PERCENT)
    return nearest_hashed(damaged, ORDER_FEATURES, "o_orderstatus", K, bucket_rows=256)


def knn_hashed_recall(spark, folder):
    """The approximate search beside the exact one: rows asked, whether all got k, recall of 0.9, true distances."""
    damaged = erase(_orders(spark, folder), "o_orderstatus", PERCENT)
    # Both searches read the same written rows.
    places = places_of(damaged, ORDER_FEATURES, "o_orderstatus", K)
    exact = nearest(damaged, ORDER_FEATURES, "o_orderstatus", K, places=places)
    found = nearest_hashed(damaged, ORDER_FEATURES, "o_orderstatus", K, bucket_rows=256, places=places)
    found = found.withColumnsRenamed({"d2": "found_d2", "rank": "found_rank"}).drop("value")
    both = found.join(exact, ["line_id", "neighbour_id"], "full")
    return both.agg(
        F.count_distinct("line_id").alias("asked"),
        (F.count("found_rank") == K * F.count_distinct("line_id")).alias("all_full"),
        (F.count_if(F.col("found_rank").isNotNull() & F.col("rank").isNotNull()) >= 0.9 * F.count("rank")).alias("recall_reached"),
        F.bool_and(F.coalesce(F.col("found_d2") == F.col("d2"), F.lit(True))).alias("distances_true"),
    )


# --- scoring -----------------------------------------------------------------


def _knn_report(spark, folder) -> Report:
    return run_experiment(_customer(spark, folder), CUSTOMER_FEATURES, "c_mktsegment", "knn", PERCENT, k=K)


def score_detail(spark, folder):
    return _knn_report(spark, folder).detail.orderBy("line_id")


def score_detail_sql(spark, folder):
    """The scorer as a user's SQL over named tables."""
    customer = _customer(spark, folder)
    return _knn_report(spark, folder).sql(
        """SELECT d.line_id, o.c_mktsegment AS original_value, d.imputed_value,
            CAST(d.imputed_value <> o.c_mktsegment AS INT) AS error FROM {detail} d JOIN {original} o ON d.line_id = o.line_id""",
        original=customer,
    )


def report_store(spark, folder):
    """Two cells stored, one of them twice: the store holds each once."""
    path = written_path(spark, "store")
    first = _knn_report(spark, folder)
    for percent in (10, 20, 10):
        first.store(path, "knn", percent)
    return load_parquet(spark, f"{path}/summary")


def detail_sink(spark, folder):
    path = written_path(spark, "detail")
    write_detail(_knn_report(spark, folder).detail, path)
    return load_parquet(spark, path)


def knn_summary_exact(spark, folder):
    report = run_experiment(_customer(spark, folder), CUSTOMER_FEATURES, "c_mktsegment", "knn", 12.5, k=K, erase="exact")
    return report.summary


def knn_summary(spark, folder):
    return _knn_report(spark, folder).summary


def report_sink(spark, folder):
    path = written_path(spark, "report")
    _knn_report(spark, folder).save(path)
    return load_parquet(spark, f"{path}/summary")


# --- learners ----------------------------------------------------------------


def _learner_detail(method, mode):
    def query(spark, folder):
        report = run_experiment(
            _orders(spark, folder), ORDER_FEATURES, "o_orderstatus", method, PERCENT, codes=ORDER_CODES, mode=mode
        )
        return report.detail

    return query


def _learner_summary(method, mode):
    def query(spark, folder):
        return Report(_learner_detail(method, mode)(spark, folder)).summary

    return query


def _scored_rows(method, mode):
    """Which rows get a value, their originals, and that the value is a known class."""

    def query(spark, folder):
        detail = _learner_detail(method, mode)(spark, folder)
        in_domain = F.col("imputed_value").isin(*ORDER_CODES)
        if mode == "compat":
            # "Missing" is a class of its own there, and shows as null.
            in_domain = in_domain | F.col("imputed_value").isNull()
        return detail.select("line_id", "original_value", in_domain.alias("in_domain"))

    return query


def _stump_report(method, **settings):
    """A depth-1 tree whose imputed values SQL can work out."""

    def report(spark, folder):
        return run_experiment(_customer(spark, folder), ["c_nationkey"], "c_mktsegment", method, PERCENT, max_depth=1, **settings)

    return report


_tree_stump = _stump_report("tree")
_forest_stump = _stump_report("forest", num_trees=1, feature_subset="all", bootstrap=False)


def dt_impute_stump(spark, folder):
    return _tree_stump(spark, folder).detail


def rf_impute_stump(spark, folder):
    return _forest_stump(spark, folder).detail


def dt_summary_stump(spark, folder):
    return _tree_stump(spark, folder).summary


def _scored_embeddings(method, **settings):
    """Learners on an array column: which vectors get a label, and that it is one of the labels."""

    def query(spark, folder):
        detail = run_experiment(_embeddings(spark, folder), "embedding", "label", method, PERCENT, **settings).detail
        return detail.select("line_id", "original_value", F.col("imputed_value").isNotNull().alias("filled"))

    return query


def _first_letter(column):
    """An encoder that is an expression: the place of the first letter in the alphabet."""
    return F.ascii(column) - 64


def dt_impute_encoder(spark, folder):
    """The depth-1 tree with codes from an expression, and their way back from the data."""
    customer = _customer(spark, folder)
    codes = fit_encoder(customer, "c_mktsegment", _first_letter)
    return run_experiment(customer, ["c_nationkey"], "c_mktsegment", "tree", PERCENT, codes=codes, max_depth=1).detail


def _compiled(spark, folder, fitted):
    """Learner and table side by side for every missing order: the class by each, and whether they agree."""
    damaged = erase(_orders(spark, folder), "o_orderstatus", PERCENT)
    plan = plan_training(damaged, ORDER_FEATURES, "o_orderstatus", ORDER_CODES)
    model, classes = fitted(plan)
    predicted = model.transform(plan.ask).select("line_id", vector_to_array("features").alias("features"), F.col("prediction").cast("int").alias("predicted"))
    known = F.col("predicted").between(0, len(ORDER_CODES) - 1)
    return classes(predicted).select("line_id", (F.col("class") == F.col("predicted")).alias("agrees"), known.alias("in_domain"))


def dt_impute_nodes(spark, folder):
    """A tree of depth 5 compiled from its node table into one expression."""

    def fitted(plan):
        model = DecisionTreeClassifier(maxDepth=5, maxBins=32, seed=42).fit(plan.train)
        nodes = node_table(spark, model).collect()
        return model, lambda rows: rows.withColumn("class", tree_class(nodes, F.col("features")))

    return _compiled(spark, folder, fitted)


def rf_impute_nodes(spark, folder):
    """Ten trees walked by joins with their node table, votes included."""

    def fitted(plan):
        model = RandomForestClassifier(numTrees=10, maxDepth=5, maxBins=32, seed=42).fit(plan.train)
        nodes = node_table(spark, model)
        return model, lambda rows: rows.join(walk_nodes(rows, nodes, 5), "line_id")

    return _compiled(spark, folder, fitted)


def mlp_impute_weights(spark, folder):
    """A perceptron's forward pass as an expression over its weight table."""

    def fitted(plan):
        layers = [plan.width, 5, plan.classes]
        model = MultilayerPerceptronClassifier(layers=layers, blockSize=128, maxIter=145, seed=1234).fit(plan.train)
        weights = weight_table(spark, model, layers).collect()
        return model, lambda rows: rows.withColumn("class", perceptron_class(weights, F.col("features")))

    return _compiled(spark, folder, fitted)


def dt_stump(spark, folder):
    """Depth-1 tree from nation to market segment: the rows on each side of its split."""
    customer = _customer(spark, folder)
    codes = discover_codes(customer, "c_mktsegment")
    plan = plan_training(customer, ["c_nationkey"], "c_mktsegment", codes)
    stump = DecisionTreeClassifier(maxDepth=1, maxBins=32, impurity="gini", leafCol="leaf").fit(plan.train)
    rows = customer.select(
        F.col("c_nationkey").alias("key"), array_to_vector(F.array(F.col("c_nationkey").cast("double"))).alias("features")
    )
    sides = stump.transform(rows).groupBy("leaf", "prediction").agg(
        F.min("key").alias("lowest"), F.max("key").alias("highest"), F.count("*").alias("n")
    )
    return sides.select(
        F.col("leaf").cast("int").alias("side"),
        category_of(F.col("prediction") + 1, codes).alias("imputed_value"),
        "lowest", "highest", "n",
    )


# --- comparison --------------------------------------------------------------


def compare_methods(spark, folder):
    return compare_grid(_customer(spark, folder), CUSTOMER_FEATURES, "c_mktsegment", methods=METHODS, percents=PERCENTS, k=K)


def compare_counts(spark, folder):
    return compare_methods(spark, folder).select("method", "percent", "n")


def compare_knn(spark, folder):
    """k-NN at every percent, with the percent as k."""
    return compare_grid(_customer(spark, folder), CUSTOMER_FEATURES, "c_mktsegment", methods=["knn"], k="percent")


def all_queries() -> dict[str, Query]:
    named: dict[str, Query] = {
        "load_as_strings": load_as_strings,
        "load_csv": load_csv_strings,
        "row_id": row_id,
        "row_id_generated": row_id_generated,
        "project_attributes": project,
        "encode_target": encode_target,
        "decode_target": decode_target,
        "is_numeric": is_numeric,
        "clean_numeric": clean_numeric,
        "cast_double": cast_double,
        "cast_long": cast_long,
        "erase_target": erase_target,
        "erase_exact": erase_exact_target,
        "erase_exact_orders": erase_exact_orders,
        "split_70_30": split_70_30,
        "pairwise_distance": pairwise_distance,
        "knn_neighbours": knn_neighbours,
        "knn_neighbours_embeddings": knn_neighbours_embeddings,
        "knn_votes": knn_votes,
        "knn_impute": knn_impute_customer,
        "knn_impute_embeddings": knn_impute_embeddings,
        "knn_impute_orders": knn_impute_orders,
        "knn_impute_part": knn_impute_part,
        "knn_impute_lineitem": knn_impute_lineitem,
        "knn_neighbours_hashed": knn_neighbours_hashed,
        "knn_hashed_recall": knn_hashed_recall,
        "score_detail": score_detail,
        "score_detail_sql": score_detail_sql,
        "report_store": report_store,
        "detail_sink": detail_sink,
        "knn_summary": knn_summary,
        "knn_summary_exact": knn_summary_exact,
        "report_sink": report_sink,
        "dt_stump": dt_stump,
        "dt_impute_stump": dt_impute_stump,
        "rf_impute_stump": rf_impute_stump,
        "dt_impute_encoder": dt_impute_encoder,
        "dt_impute_nodes": dt_impute_nodes,
        "rf_impute_nodes": rf_impute_nodes,
        "mlp_impute_weights": mlp_impute_weights,
        "dt_summary_stump": dt_summary_stump,
        "scored_embeddings_dt": _scored_embeddings("tree"),
        "scored_embeddings_rf": _scored_embeddings("forest"),
        "scored_embeddings_mlp": _scored_embeddings("perceptron", max_iter=20),
        "pairwise_distance_embeddings": pairwise_distance_embeddings,
        "compare_grid": compare_methods,
        "compare_grid_counts": compare_counts,
        "compare_grid_knn": compare_knn,
    }
    for short, method in (("dt", "tree"), ("rf", "forest"), ("mlp", "perceptron")):
        named[f"{short}_impute"] = _learner_detail(method, "known")
        named[f"{short}_summary"] = _learner_summary(method, "known")
        named[f"{short}_summary_compat"] = _learner_summary(method, "compat")
        named[f"scored_rows_{short}"] = _scored_rows(method, "known")
        named[f"scored_rows_{short}_compat"] = _scored_rows(method, "compat")
    return named
