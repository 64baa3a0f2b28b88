"""The same queries as plain SQL, for checking results in another engine."""

from lacuna.functions import percent_cut

from .experiment import METHODS, PERCENTS
from .queries import K, PERCENT


def _erased(row_id: str, percent: int = PERCENT, seed: str = "42") -> str:
    return f"md5('{seed}:' || {row_id}::VARCHAR) < '{percent_cut(percent)}'"


_MIXED = """
    SELECT event_id, CASE event_id % 8
        WHEN 0 THEN '?' WHEN 2 THEN event_id || 'e5' WHEN 3 THEN '.' || event_id
        WHEN 4 THEN '-' || event_id WHEN 5 THEN event_id || '.25' WHEN 6 THEN ' ' || event_id
        WHEN 7 THEN '+' || event_id END AS v,
        CASE WHEN event_id % 5 = 1 THEN 'x' WHEN event_id % 5 <> 0 THEN event_id || '.5' END AS w
    FROM events"""
_NUMBER = r"regexp_full_match(v, '[-+]?\d+(\.\d+)?')"


def _points(table: str, key: str, target: str, features: list[str], percent: int = PERCENT) -> str:
    columns = ", ".join(f"({f})::DOUBLE AS f{i}" for i, f in enumerate(features))
    return (
        f"SELECT {key} AS id, {target}::VARCHAR AS original, "
        f"CASE WHEN NOT ({_erased(key, percent)}) THEN {target}::VARCHAR END AS t, {columns} FROM {table}"
    )


def _distance(count: int) -> str:
    return " + ".join(f"(m.f{i} - k.f{i}) * (m.f{i} - k.f{i})" for i in range(count))


def _neighbours(points: str, d2: str, k: int = K) -> str:
    """CTEs ``points`` and ``near``: all pairs, ranked, the first k kept."""
    return f"""
    points AS ({points}),
    pairs AS (
        SELECT m.id AS line_id, k.id AS neighbour_id, k.t AS value, {d2} AS d2
        FROM points m, points k WHERE m.t IS NULL AND k.t IS NOT NULL),
    near AS (
        SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY d2, neighbour_id)::INTEGER AS rank
        FROM pairs QUALIFY rank <= {k}),
    counted AS (SELECT line_id, value, count(*) AS votes FROM near GROUP BY ALL),
    imputed AS (
        SELECT line_id, value AS imputed_value FROM counted
        QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY votes DESC, value) = 1),
    detail AS (
        SELECT line_id, original AS original_value, imputed_value,
            (imputed_value IS DISTINCT FROM original)::INTEGER AS error
        FROM imputed JOIN points ON line_id = id)"""


_CUSTOMER = _neighbours(
    _points("customer", "c_custkey", "c_mktsegment", ["c_acctbal", "c_nationkey"]), _distance(2)
)
_ORDERS = _neighbours(
    _points("orders", "o_orderkey", "o_orderstatus",
            ["o_totalprice", "o_custkey", "year(o_orderdate)", "month(o_orderdate)"]),
    _distance(4),
)
_PART = _neighbours(_points("part", "p_partkey", "p_type", ["p_size", "p_retailprice"], 50), _distance(2))
_EMBEDDINGS = _neighbours(
    f"""SELECT vec_id AS id, label::VARCHAR AS original,
        CASE WHEN NOT ({_erased('vec_id')}) THEN label::VARCHAR END AS t,
        embedding::DOUBLE[] AS e FROM embeddings""",
    "list_reduce(list_transform(range(1, len(m.e) + 1), lambda i: (m.e[i] - k.e[i]) * (m.e[i] - k.e[i])), "
    "lambda x, y: x + y)",
)

_SUMMARY = """
    SELECT count(*) AS n, count(*) FILTER (error = 1) AS total_error,
        count(*) FILTER (error = 1) * 100.0::DOUBLE / nullif(count(*), 0) AS avg_percent_error
    FROM detail"""


def _exact(table: str, key: str, target: str, percent: int) -> str:
    return f"""
    WITH ranked AS (
        SELECT {key} AS line_id, {target} AS original,
            row_number() OVER (ORDER BY md5('42:' || {key}::VARCHAR), {key}) AS place, count(*) OVER () AS total
        FROM {table})
    SELECT line_id, CASE WHEN place > (total * {percent} + 50) // 100 THEN original END AS {target} FROM ranked"""


def _scored(mode: str) -> str:
    outside = "" if mode == "known" else f" AND NOT ({_erased('o_orderkey', 70, 'split:1234')})"
    return f"""
    SELECT o_orderkey AS line_id, o_orderstatus AS original_value, TRUE AS in_domain
    FROM orders WHERE {_erased('o_orderkey')}{outside}"""


_STUMP = """
    WITH cells AS (SELECT c_nationkey AS key, c_mktsegment AS class, count(*) AS n FROM customer GROUP BY ALL),
    cuts AS (
        SELECT (key + lead(key) OVER (ORDER BY key)) / 2.0 AS cut FROM (SELECT DISTINCT key FROM cells)
        QUALIFY cut IS NOT NULL),
    sides AS (
        SELECT cut, (key > cut)::INTEGER AS side, class, sum(n) AS n, min(key) AS lowest, max(key) AS highest
        FROM cells, cuts GROUP BY ALL),
    impurity AS (
        SELECT cut, side, sum(n) * (1 - sum((n / total) ^ 2)) AS g
        FROM (SELECT *, sum(n) OVER (PARTITION BY cut, side) AS total FROM sides) GROUP BY ALL),
    best AS (SELECT cut FROM impurity GROUP BY cut ORDER BY sum(g), cut LIMIT 1)
    SELECT side, arg_max(class, (n, -dense)) AS imputed_value, min(lowest) AS lowest, max(highest) AS highest,
        sum(n)::BIGINT AS n
    FROM (SELECT *, dense_rank() OVER (ORDER BY class) AS dense FROM sides SEMI JOIN best USING (cut)) GROUP BY side"""


_STUMP_DETAIL = f"""
    WITH points AS (
        SELECT c_custkey AS id, c_nationkey AS key, c_mktsegment AS original,
            CASE WHEN NOT ({_erased('c_custkey')}) THEN c_mktsegment END AS t FROM customer),
    cells AS (SELECT key, t AS class, count(*) AS n FROM points WHERE t IS NOT NULL GROUP BY ALL),
    cuts AS (
        SELECT (key + lead(key) OVER (ORDER BY key)) / 2.0 AS cut FROM (SELECT DISTINCT key FROM cells)
        QUALIFY cut IS NOT NULL),
    sides AS (SELECT cut, key > cut AS side, class, sum(n) AS n FROM cells, cuts GROUP BY ALL),
    impurity AS (
        SELECT cut, side, sum(n) * (1 - sum((n / total) ^ 2)) AS g
        FROM (SELECT *, sum(n) OVER (PARTITION BY cut, side) AS total FROM sides) GROUP BY ALL),
    best AS (SELECT cut FROM impurity GROUP BY cut ORDER BY sum(g), cut LIMIT 1),
    chosen AS (
        SELECT cut, side, arg_max(class, (n, -dense)) AS imputed_value
        FROM (SELECT *, dense_rank() OVER (ORDER BY class) AS dense FROM sides SEMI JOIN best USING (cut)) GROUP BY ALL),
    detail AS (
        SELECT id AS line_id, original AS original_value, imputed_value, (imputed_value <> original)::INTEGER AS error
        FROM points JOIN chosen ON (key > cut) = side WHERE t IS NULL)"""


def _summary_exact(percent: str) -> str:
    """k-NN summary with an exact number of rows erased."""
    points = f"""
        SELECT id, original, CASE WHEN place > floor(total * {percent} / 100 + 0.5) THEN original END AS t, f0, f1 FROM (
            SELECT c_custkey AS id, c_mktsegment AS original, c_acctbal AS f0, c_nationkey::DOUBLE AS f1,
                row_number() OVER (ORDER BY md5('42:' || c_custkey::VARCHAR), c_custkey) AS place, count(*) OVER () AS total
            FROM customer)"""
    return f"WITH {_neighbours(points, _distance(2))} {_SUMMARY}"


_LINE_ID = """('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
    date_diff('day', DATE '1970-01-01', l_shipdate::DATE))), 1, 15))::BIGINT"""
# The ten nearest by an aggregate of bounded size: a window would sort all pairs.
_LINEITEM = f"""
    WITH points AS (
        SELECT id, CASE WHEN NOT ({_erased('id')}) THEN original END AS t, f0, f1, f2, f3 FROM (
            SELECT {_LINE_ID} AS id, l_returnflag AS original, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3
            FROM lineitem)),
    near AS (
        SELECT m.id AS line_id, min_by(k.t, ({_distance(4)}, k.id), {K}) AS found
        FROM points m, points k WHERE m.t IS NULL AND k.t IS NOT NULL GROUP BY m.id),
    counted AS (SELECT line_id, value, count(*) AS votes FROM (SELECT line_id, unnest(found) AS value FROM near) GROUP BY ALL)
    SELECT line_id, value AS imputed_value FROM counted
    QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY votes DESC, value) = 1"""


def _grid(rows) -> str:
    return " UNION ALL ".join(rows)


def _knn_cell(percent: int) -> str:
    near = _neighbours(
        _points("customer", "c_custkey", "c_mktsegment", ["c_acctbal", "c_nationkey"], percent), _distance(2), percent
    )
    return f"SELECT 'knn' AS method, {percent} AS percent, * FROM (WITH {near} {_SUMMARY})"


def all_oracles() -> dict[str, str]:
    numbers = f"WITH mixed AS ({_MIXED})"
    detail = f"WITH {_CUSTOMER} SELECT * FROM detail"
    summary = f"WITH {_CUSTOMER} {_SUMMARY}"
    named = {
        "load_as_strings": """SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type,
            p_size::VARCHAR AS p_size, p_retailprice::VARCHAR AS p_retailprice FROM part""",
        "load_csv": """SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey,
            c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer""",
        "row_id": "SELECT *, c_custkey AS line_id FROM customer",
        "row_id_generated": "SELECT count(*) AS n, count(*) AS ids FROM lineitem",
        "project_attributes": "SELECT c_custkey AS line_id, c_nationkey, c_mktsegment FROM customer",
        "encode_target": f"""SELECT o_orderkey, (CASE WHEN {_erased('o_orderkey')} THEN 0
            WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END)::DOUBLE AS code FROM orders""",
        "decode_target": f"""SELECT o_orderkey, CASE WHEN NOT ({_erased('o_orderkey')}) AND o_orderstatus IN ('F', 'P')
            THEN o_orderstatus END AS category FROM orders""",
        "is_numeric": f"{numbers} SELECT event_id, coalesce({_NUMBER}, FALSE) AS ok FROM mixed",
        "clean_numeric": f"{numbers} SELECT event_id, v::DOUBLE AS v, w::DOUBLE AS w FROM mixed WHERE {_NUMBER} AND event_id % 5 > 1",
        "cast_double": f"{numbers} SELECT event_id, v::DOUBLE AS number FROM mixed WHERE {_NUMBER}",
        "cast_long": rf"""{numbers} SELECT event_id,
            CASE WHEN regexp_full_match(v, '[-+]?\d+') THEN TRY_CAST(v AS BIGINT) END AS number FROM mixed""",
        "erase_target": f"""SELECT c_custkey AS line_id,
            CASE WHEN NOT ({_erased('c_custkey')}) THEN c_mktsegment END AS c_mktsegment FROM customer""",
        "erase_exact": _exact("customer", "c_custkey", "c_mktsegment", PERCENT),
        "erase_exact_orders": _exact("orders", "o_orderkey", "o_orderstatus", 30),
        "split_70_30": f"""SELECT c_custkey AS line_id,
            CASE WHEN {_erased('c_custkey', 70, 'split:1234')} THEN 'train' ELSE 'test' END AS part FROM customer""",
        "pairwise_distance": f"""
            WITH points AS ({_points('customer', 'c_custkey', 'c_mktsegment', ['c_acctbal', 'c_nationkey'])}),
            one AS (SELECT * FROM points WHERE t IS NULL ORDER BY id LIMIT 1)
            SELECT k.id AS neighbour_id, k.t AS value, sqrt({_distance(2)}) AS distance
            FROM points k, one m WHERE k.t IS NOT NULL""",
        "knn_neighbours": f"WITH {_CUSTOMER} SELECT line_id, neighbour_id, value, d2, rank FROM near",
        "knn_neighbours_embeddings": f"WITH {_EMBEDDINGS} SELECT line_id, neighbour_id, value, rank FROM near",
        "knn_votes": f"WITH {_CUSTOMER} SELECT line_id, value, votes FROM counted",
        "knn_impute": f"WITH {_CUSTOMER} SELECT * FROM imputed",
        "knn_impute_embeddings": f"WITH {_EMBEDDINGS} SELECT * FROM imputed",
        "knn_impute_orders": f"WITH {_ORDERS} SELECT * FROM imputed",
        "knn_impute_part": f"WITH {_PART} SELECT * FROM imputed",
        "score_detail": detail,
        "detail_sink": detail,
        "score_detail_sql": detail,
        "report_store": f"WITH {_CUSTOMER}, total AS ({_SUMMARY}) SELECT total.*, 'knn' AS method, percent FROM total, (SELECT unnest([10.0::DOUBLE, 20.0::DOUBLE]) AS percent)",
        "knn_summary": summary,
        "report_sink": summary,
        "dt_stump": _STUMP,
        "dt_impute_stump": f"{_STUMP_DETAIL} SELECT * FROM detail",
        "rf_impute_stump": f"{_STUMP_DETAIL} SELECT * FROM detail",
        "dt_summary_stump": f"{_STUMP_DETAIL} {_SUMMARY}",
        "dt_impute_encoder": f"{_STUMP_DETAIL} SELECT * FROM detail",
        "knn_hashed_recall": f"""SELECT count(*) AS asked, TRUE AS all_full, TRUE AS recall_reached, TRUE AS distances_true
            FROM orders WHERE {_erased('o_orderkey')}""",
        "knn_summary_exact": _summary_exact("12.5"),
        "knn_impute_lineitem": _LINEITEM,
        "pairwise_distance_embeddings": f"""
            WITH {_EMBEDDINGS} SELECT neighbour_id, value, sqrt(d2) AS distance
            FROM pairs WHERE line_id = (SELECT min(line_id) FROM pairs)""",
        "compare_grid_counts": _grid(
            f"SELECT '{method}' AS method, {percent} AS percent, count(*) AS n "
            f"FROM customer WHERE {_erased('c_custkey', percent)}"
            for method in METHODS for percent in PERCENTS
        ),
        "compare_grid_knn": _grid(_knn_cell(percent) for percent in PERCENTS),
    }
    for name in ("dt_impute_nodes", "rf_impute_nodes", "mlp_impute_weights"):
        # That the table says what the learner says; the tests redo it in SQL over the written tables.
        named[name] = f"SELECT o_orderkey AS line_id, TRUE AS agrees, TRUE AS in_domain FROM orders WHERE {_erased('o_orderkey')}"
    for short in ("dt", "rf", "mlp"):
        named[f"scored_rows_{short}"] = _scored("known")
        named[f"scored_rows_{short}_compat"] = _scored("compat")
        named[f"scored_embeddings_{short}"] = f"""
            SELECT vec_id AS line_id, label::VARCHAR AS original_value, TRUE AS filled
            FROM embeddings WHERE {_erased('vec_id')}"""
    return named
