"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from driftspan.plans.queries import BATCH, DIMS, SEED


def _key(row_id: str, prefix: str = f"{SEED}:") -> str:
    return f"md5('{prefix}' || CAST({row_id} AS VARCHAR))"


def _random(row_id: str, n: int) -> str:
    return f"CAST(CAST('0x' || substr({_key(row_id)}, 1, 8) AS BIGINT) % {n} AS INTEGER)"


def _bin(x: str, n: int) -> str:
    """Right-closed equal-width bin of x; s has lo and hi."""
    return " + ".join(f"CAST({x} > lo + {i} * ((hi - lo) / {n}) AS INTEGER)" for i in range(1, n))


def _stratified(table: str, row_id: str, numeric: tuple[str, int] | None, other: str | None) -> str:
    """CTEs ending in a(row_id, ..., partition_id): ids of the combined keys by first appearance."""
    keys = []
    if numeric:
        keys.append(f"{_bin(numeric[0], numeric[1])} AS k0")
    if other:
        keys.append(f"{other} AS k1")
    names = ", ".join(k.rsplit(" ", 1)[1] for k in keys)
    stats = f"SELECT min({numeric[0]}) AS lo, max({numeric[0]}) AS hi FROM {table}" if numeric else "SELECT 0 AS lo, 0 AS hi"
    return f"""s AS ({stats}),
    b AS (SELECT t.*, {', '.join(keys)} FROM {table} t, s),
    f AS (SELECT {names}, CAST(row_number() OVER (ORDER BY min({row_id})) - 1 AS INTEGER) AS partition_id FROM b GROUP BY {names}),
    a AS (SELECT b.*, f.partition_id FROM b JOIN f ON {' AND '.join(f'b.{k} IS NOT DISTINCT FROM f.{k}' for k in names.split(', '))})"""


def _quota(name: str, source: str, ratio: float) -> str:
    """CTEs {name}(y, q): rows to draw of each class in source(y, n), by largest remainders."""
    return f"""{name}_t AS (SELECT sum(n) AS total, CAST(floor({ratio}e0 * sum(n)) AS BIGINT) AS wanted FROM {source}),
    {name}_b AS (SELECT y, n, wanted, CAST(wanted * n AS BIGINT) // CAST(total AS BIGINT) AS base, CAST(wanted * n AS BIGINT) % CAST(total AS BIGINT) AS rem FROM {source}, {name}_t),
    {name} AS (SELECT y, CAST(base + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= wanted - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS q FROM {name}_b)"""


def _split(assigned: str, row_id: str, target: str, mode: int, train: float = 0.7, test: float = 0.3, ids: str = "(0, 1)", oods: str = "(2)") -> str:
    """CTEs ending in sp(row, is_ood, role, *), over CTEs that end in a."""
    ood_rank = "is_ood" if mode != 3 else "false"
    out = f"""{assigned},
    m AS (SELECT *, partition_id IN {oods} AS is_ood, partition_id IN {ids} OR partition_id IN {oods} AS used, {target} AS y FROM a),
    r AS (SELECT *, row_number() OVER (PARTITION BY used, {ood_rank}, y ORDER BY {_key(row_id)}, {row_id}) AS rk FROM m),
    n0 AS (SELECT y, count(*) AS n FROM m WHERE used AND NOT {ood_rank} GROUP BY y),
    n1 AS (SELECT y, count(*) AS n FROM m WHERE used AND {ood_rank} GROUP BY y),
    {_quota('q0', 'n0', train)},
    rest AS (SELECT y, n - q AS n FROM n0 JOIN q0 USING (y)),
    {_quota('qr', 'rest', test)},
    {_quota('q1', 'n1', test)}"""
    if mode == 3:
        test_id = "q0.q + 1000000000"
    else:
        test_id = "q0.q + qr.q" if mode in (0, 2) else "q0.q"
    test_ood = "q1.q" if mode in (1, 2) else "0"
    return f"""{out},
    sp AS (
      SELECT r.*, CASE WHEN NOT used THEN 'unused'
        WHEN NOT {ood_rank} AND rk <= q0.q THEN 'train'
        WHEN NOT {ood_rank} AND rk <= {test_id} THEN 'test'
        WHEN {ood_rank} AND rk <= {test_ood} THEN 'test' ELSE 'unused' END AS role
      FROM r LEFT JOIN q0 ON r.y = q0.y LEFT JOIN qr ON r.y = qr.y LEFT JOIN q1 ON r.y = q1.y
    )"""


def _random_orders() -> str:
    return f"a AS (SELECT *, {_random('o_orderkey', 4)} AS partition_id FROM orders)"


def _split_mode(mode: int) -> str:
    return f"WITH {_split(_random_orders(), 'o_orderkey', 'o_orderstatus', mode)} SELECT o_orderkey, is_ood, role FROM sp"


_EVENTS = f"a AS (SELECT *, {_random('event_id', 3)} AS partition_id FROM events)"
_EPOCH = f"""WITH {_EVENTS}, r AS (SELECT event_id, row_number() OVER (ORDER BY {_key('event_id', f'{SEED}:1:')}, event_id) - 1 AS p FROM a)
    SELECT event_id, CAST(p // {BATCH} AS BIGINT) AS batch_id, CAST(p % {BATCH} AS BIGINT) AS batch_pos FROM r"""


def _mode_batch(train_ood: bool, test_id: bool, test_ood: bool) -> str:
    parts = []
    for role, fraction, use_id, use_ood in (("train", 0.5, True, train_ood), ("test", 0.25, test_id, test_ood)):
        k_id = f"CAST(floor(n_id * {fraction}e0) AS BIGINT)" if use_id else "0"
        k_ood = f"CAST(floor(n_ood * {fraction}e0) AS BIGINT)" if use_ood else "0"
        place = f"CASE WHEN ood THEN rk + {k_id} ELSE rk END - 1"
        parts.append(f"SELECT event_id, partition_id, '{role}' AS role, CAST({place} AS BIGINT) AS batch_pos FROM r, n WHERE rk <= CASE WHEN ood THEN {k_ood} ELSE {k_id} END AND {place} < 5000")
    return f"""WITH {_EVENTS},
    r AS (SELECT *, partition_id <> 0 AS ood, row_number() OVER (PARTITION BY partition_id <> 0 ORDER BY {_key('event_id')}, event_id) AS rk FROM a),
    n AS (SELECT count(*) FILTER (partition_id = 0) AS n_id, count(*) FILTER (partition_id <> 0) AS n_ood FROM a)
    {' UNION ALL '.join(parts)}"""


_GAPS = "g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status FROM orders)"
_MODE = "md AS (SELECT status AS fill FROM {0} WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)"


def _impute(value: str) -> str:
    return f"WITH {_GAPS}, s AS (SELECT {value} AS fill FROM g) SELECT o_orderkey, round(coalesce(price, fill), 6) AS price FROM g, s"


def _prep_transform() -> str:
    hot = {s: f"CAST(coalesce(status, fill) = '{s}' AS INTEGER)" for s in "FOP"}
    stats = ", ".join(f"avg({e}) AS mean_{s}, stddev_pop({e}) AS sd_{s}" for s, e in hot.items())
    cols = ", ".join(f"round(({e} - mean_{s}) / CASE WHEN sd_{s} = 0 THEN 1 ELSE sd_{s} END, 6) + 0e0 AS status_{s}" for s, e in hot.items())
    return f"""WITH {_GAPS}, even AS (SELECT * FROM g WHERE o_orderkey % 2 = 0), {_MODE.format('even')}, mm AS (SELECT median(price) AS mid FROM even),
    st AS (SELECT avg(coalesce(price, mid)) AS ap, stddev_pop(coalesce(price, mid)) AS dp, {stats} FROM even, md, mm)
    SELECT o_orderkey, round((coalesce(price, mid) - ap) / dp, 6) + 0e0 AS price, {cols} FROM g, md, mm, st"""


_GUESS = "g AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 200000 THEN 'F' WHEN o_totalprice > 60000 THEN 'O' ELSE 'P' END AS p, o_custkey % 3 = 0 AS is_ood FROM orders)"


def _roc(source: str = "SELECT round(l_discount * l_quantity, 4) AS score, l_returnflag = 'R' AS pos FROM lineitem", prefix: str = "") -> str:
    p = prefix
    return f"""{p}c AS (SELECT score, sum(CAST(pos AS BIGINT)) AS p, sum(1 - CAST(pos AS BIGINT)) AS n FROM ({source}) GROUP BY score),
    {p}w AS (SELECT score, p, n, sum(p) OVER o AS tp, sum(n) OVER o AS fp, lead(p) OVER (ORDER BY score DESC) AS lp, lead(n) OVER (ORDER BY score DESC) AS ln,
      row_number() OVER (ORDER BY score DESC) AS k, sum(p) OVER () AS ap, sum(n) OVER () AS an
      FROM {p}c WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    {p}roc AS (SELECT *, k = 1 OR lp IS NULL OR lp <> p OR ln <> n AS kept FROM {p}w)"""


def _auroc(p: str = "") -> str:
    return f"(SELECT CASE WHEN max(ap) > 0 AND max(an) > 0 THEN sum(n * ((tp - p) + p / 2e0)) / (CAST(max(ap) AS DOUBLE) * max(an)) END FROM {p}roc)"


def _fpr(p: str = "") -> str:
    return f"(SELECT CASE WHEN max(ap) > 0 AND max(an) > 0 THEN coalesce(min(CASE WHEN kept AND CAST(tp AS DOUBLE) / ap >= 0.95e0 THEN CAST(fp AS DOUBLE) / an END), max(CAST(fp AS DOUBLE) / an)) END FROM {p}roc)"


def _hist() -> str:
    number = " + ".join(f"CAST(x >= lo + {i}e0 * ((hi - lo) / 20e0) AS INTEGER)" for i in range(1, 20))
    return f"""v AS (SELECT l_extendedprice AS x, l_returnflag = 'R' AS ood FROM lineitem),
    s AS (SELECT min(x) AS lo, max(x) AS hi FROM v WHERE NOT ood),
    b AS (SELECT {number} AS bin, ood FROM v, s WHERE x >= lo AND x <= hi),
    c AS (SELECT bin, count(*) FILTER (NOT ood) AS p, count(*) FILTER (ood) AS q FROM b GROUP BY bin),
    d AS (SELECT CAST(i AS INTEGER) AS bin, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM range(20) t(i) LEFT JOIN c ON c.bin = i),
    h AS (SELECT bin, p / (sum(p) OVER () * ((hi - lo) / 20)) AS p, q / (sum(q) OVER () * ((hi - lo) / 20)) AS q FROM d, s)"""


def _kl(p: str, q: str, source: str) -> str:
    e = "1e-12"
    return f"(SELECT sum(x * ln(x / y)) FROM (SELECT ({p} + {e}) / sum({p} + {e}) OVER () AS x, ({q} + {e}) / sum({q} + {e}) OVER () AS y FROM {source}))"


def _js(source: str) -> str:
    return f"0.5e0 * {_kl('p', '((p + q) / 2)', source)} + 0.5e0 * {_kl('q', '((p + q) / 2)', source)}"


_PRIORITIES = "h AS (SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS p, CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) AS q FROM orders GROUP BY o_orderpriority)"


def _neighbours(dims: int) -> str:
    """CTEs ending in p(vec_id, x0, ..., label, r): each row's others by distance."""
    x = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(dims))
    d = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(dims))
    return f"""e AS (SELECT vec_id, {x}, label FROM embeddings),
    k AS (SELECT greatest(1, CAST(floor(count(*) * 0.1e0) AS BIGINT)) AS k FROM e),
    p AS (SELECT a.vec_id, {', '.join(f'b.x{i}' for i in range(dims))}, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(sqrt({d}), 9), b.vec_id) AS r FROM e a, e b WHERE a.vec_id <> b.vec_id)"""


def _knn() -> str:
    var = ", ".join(f"round(var_samp(x{i}), 6) AS var{i}" for i in range(DIMS))
    return f"WITH {_neighbours(DIMS)} SELECT vec_id, {var} FROM p, k WHERE r <= k GROUP BY vec_id"


def _knn_metafeatures() -> str:
    per = [f.format(f"x{i}") for f in ("avg({0})", "stddev_samp({0})", "min({0})", "max({0})", "max({0}) - min({0})") for i in range(3)]
    per += ["count(*)", "3", "count(*) / 3e0", "count(DISTINCT label)", "entropy(label)"]
    values = ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS m{i}" for i, v in enumerate(per))
    return f"WITH {_neighbours(3)} SELECT vec_id, {values} FROM p, k WHERE r <= k GROUP BY vec_id"


def _knn_summaries() -> str:
    names = ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS m{i}" for i, v in enumerate(("least(a, b, c)", "greatest(a, b, c)", "greatest(a, b, c) - least(a, b, c)", "lo", "hi", "hi - lo")))
    return f"""WITH {_neighbours(3)}, v AS (SELECT vec_id, var_samp(x0) AS a, var_samp(x1) AS b, var_samp(x2) AS c FROM p, k WHERE r <= k GROUP BY vec_id),
    f AS (SELECT vec_id, label, count(*) / sum(count(*)) OVER (PARTITION BY vec_id) AS share FROM p, k WHERE r <= k GROUP BY vec_id, label),
    s AS (SELECT vec_id, min(share) AS lo, max(share) AS hi FROM f GROUP BY vec_id)
    SELECT v.vec_id, {names}, CAST(6 AS INTEGER) AS width FROM v JOIN s USING (vec_id)"""


def _logreg(steps: int = 12) -> str:
    """Newton's method for an intercept and one weight, then the pipeline's metrics."""
    assigned = f"a AS (SELECT o_orderkey, o_totalprice / 100000 AS x, CAST(o_orderstatus = 'F' AS INTEGER) AS c, {_random('o_orderkey', 3)} AS partition_id FROM orders)"
    parts = ["w0 AS (SELECT 0e0 AS b, 0e0 AS m)"]
    for i in range(steps):
        parts.append(f"""g{i} AS (SELECT sum(pr - y) AS gb, sum((pr - y) * x) AS gm, sum(pr * (1 - pr)) AS hbb, sum(pr * (1 - pr) * x) AS hbm, sum(pr * (1 - pr) * x * x) AS hmm
          FROM (SELECT y, x, 1 / (1 + exp(-(b + m * x))) AS pr FROM sp, w{i} WHERE role = 'train'))""")
        parts.append(f"w{i + 1} AS (SELECT b - (hmm * gb - hbm * gm) / (hbb * hmm - hbm * hbm) AS b, m - (hbb * gm - hbm * gb) / (hbb * hmm - hbm * hbm) AS m FROM w{i}, g{i})")
    return f"""WITH {_split(assigned, 'o_orderkey', 'c', 2)}, {', '.join(parts)},
    pp AS (SELECT y, is_ood, 1 / (1 + exp(-(b + m * x))) AS pr FROM sp, w{steps} WHERE role = 'test'),
    {_roc('SELECT 1 - greatest(pr, 1 - pr) AS score, is_ood AS pos FROM pp')}
    SELECT CASE WHEN is_ood THEN 'ood' ELSE 'id' END AS scope, 'accuracy' AS metric, round(avg(CAST(y = CAST(pr > 0.5 AS INTEGER) AS DOUBLE)), 4) AS value FROM pp GROUP BY is_ood
    UNION ALL SELECT 'global', 'auroc', round({_auroc()}, 4)
    UNION ALL SELECT 'global', 'fpr@95tpr', round({_fpr()}, 4)"""


def _lloyd(iterations: int = 50, k: int = 3) -> str:
    steps = [f"""pt AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) / 100 AS x, o_totalprice / 10000 AS y FROM orders),
    c0 AS (SELECT row_number() OVER (ORDER BY {_key('o_orderkey')}, o_orderkey) - 1 AS c, x, y FROM pt QUALIFY c < {k})"""]
    for i in range(iterations + 1):
        steps.append(f"l{i} AS (SELECT o_orderkey, pt.x, pt.y, arg_min(c, struct_pack(d := (pt.x - c{i}.x) * (pt.x - c{i}.x) + (pt.y - c{i}.y) * (pt.y - c{i}.y), e := c)) AS c FROM pt, c{i} GROUP BY ALL)")
        steps.append(f"c{i + 1} AS (SELECT c, avg(x) AS x, avg(y) AS y FROM l{i} GROUP BY c)")
    return f"WITH {', '.join(steps)} SELECT o_orderkey, CAST(c AS INTEGER) AS label FROM l{iterations}"


def _pipeline() -> str:
    score = "SELECT score, is_ood AS pos FROM pr"
    return f"""WITH {_split(_stratified('orders', 'o_orderkey', ('o_totalprice', 3), None), 'o_orderkey', 'o_orderstatus', 2)},
    ce AS (SELECT y AS cls, avg(CAST(o_custkey AS DOUBLE)) AS m0, avg(o_totalprice) AS m1 FROM sp WHERE role = 'train' GROUP BY y),
    ds AS (SELECT o_orderkey, y, is_ood, cls, (o_custkey - m0) * (o_custkey - m0) + (o_totalprice - m1) * (o_totalprice - m1) AS d FROM sp, ce WHERE role = 'test'),
    pr AS (SELECT o_orderkey, any_value(y) AS y, any_value(is_ood) AS is_ood, arg_min(cls, struct_pack(a := d, b := cls)) AS guess, sqrt(min(d)) AS score FROM ds GROUP BY o_orderkey),
    {_roc(score)}
    SELECT CASE WHEN is_ood THEN 'ood' ELSE 'id' END AS scope, 'accuracy' AS metric, round(avg(CAST(y = guess AS DOUBLE)), 6) AS value FROM pr GROUP BY is_ood
    UNION ALL SELECT 'global', 'auroc', round({_auroc()}, 6)
    UNION ALL SELECT 'global', 'fpr@95tpr', round({_fpr()}, 6)"""


ORACLES = {
    "strat_numeric_labels": f"WITH {_stratified('customer', 'c_custkey', ('c_acctbal', 4), None)} SELECT c_custkey, partition_id FROM a",
    "strat_numeric_counts": f"WITH {_stratified('customer', 'c_custkey', ('c_acctbal', 4), None)} SELECT partition_id, count(*) AS n FROM a WHERE partition_id < 4 GROUP BY partition_id",
    "strat_multi_first_appearance": f"WITH {_stratified('customer', 'c_custkey', ('c_acctbal', 3), 'c_mktsegment')} SELECT c_custkey, partition_id FROM a",
    "strat_categorical": f"WITH {_stratified('events', 'event_id', None, 'event_type')} SELECT event_id, partition_id FROM a",
    "new_class_partitions": "SELECT n_nationkey, CAST(n_regionkey AS INTEGER) AS partition_id FROM nation",
    "new_class_float_target": "SELECT doc_id, CAST(trunc(quality * 1.5e0 - 0.75e0) AS INTEGER) AS partition_id FROM labels",
    "random_partition": f"SELECT o_orderkey, {_random('o_orderkey', 5)} AS partition_id FROM orders",
    "partition_sizes": f"SELECT {_random('o_orderkey', 5)} AS partition_id, count(*) AS n FROM orders GROUP BY 1",
    "partition_validate": f"WITH {_stratified('orders', 'o_orderkey', ('o_totalprice', 3), None)} SELECT partition_id, count(*) AS n FROM a WHERE partition_id < 3 GROUP BY partition_id",
    "split_stratified_counts": f"WITH n AS (SELECT o_orderstatus AS y, count(*) AS n FROM orders GROUP BY 1), {_quota('q', 'n', 0.7)} SELECT y AS o_orderstatus, q AS n FROM q",
    **{f"split_mode{m}": _split_mode(m) for m in range(4)},
    "split_unstratified": f"""WITH a AS (SELECT event_id, {_random('event_id', 2)} = 1 AS is_ood FROM events),
      r AS (SELECT *, row_number() OVER (PARTITION BY is_ood ORDER BY {_key('event_id')}, event_id) AS rk, count(*) OVER (PARTITION BY is_ood) AS n FROM a),
      q AS (SELECT *, CAST(round_even(0.5e0 * n, 0) AS BIGINT) AS k, CAST(round_even(0.3e0 * n, 0) AS BIGINT) AS o FROM r)
      SELECT event_id, is_ood, CASE WHEN is_ood THEN CASE WHEN rk <= o THEN 'test' ELSE 'unused' END
        WHEN rk <= k THEN 'train' WHEN rk <= k + CAST(round_even(0.3e0 * (n - k), 0) AS BIGINT) THEN 'test' ELSE 'unused' END AS role FROM q""",
    "split_meta_counts": f"WITH {_split(_random_orders(), 'o_orderkey', 'o_orderstatus', 2)} SELECT role, is_ood, count(*) AS n FROM sp GROUP BY role, is_ood",
    "batch_assign": _EPOCH,
    "batch_unshuffled": f"WITH {_EVENTS}, r AS (SELECT event_id, row_number() OVER (ORDER BY partition_id, event_id) - 1 AS p FROM a) SELECT event_id, CAST(p // {BATCH} AS BIGINT) AS batch_id, CAST(p % {BATCH} AS BIGINT) AS batch_pos FROM r",
    "batch_epoch_sizes": f"SELECT batch_id, count(*) AS n FROM ({_EPOCH}) GROUP BY batch_id",
    "mode_batch_train_id_test_id": _mode_batch(False, True, False),
    "mode_batch_train_id_test_ood": _mode_batch(False, False, True),
    "mode_batch_train_id_ood_test_all": _mode_batch(True, True, True),
    "mode_batch_train_id_test_all": _mode_batch(False, True, True),
    "impute_mean": _impute("avg(price)"),
    "impute_median": _impute("median(price)"),
    "impute_most_frequent": f"WITH {_GAPS}, {_MODE.format('g')} SELECT o_orderkey, coalesce(status, fill) AS status FROM g, md",
    "impute_constant": _impute("max(0e0 * price)"),
    "onehot": f"WITH {_GAPS} SELECT o_orderkey, {', '.join(f'''CAST(coalesce(status = '{s}', false) AS DOUBLE) AS status_{s}''' for s in 'FOP')}, CAST(status IS NULL AS DOUBLE) AS status_None FROM g",
    "scale_standard": f"WITH {_GAPS}, f AS (SELECT o_orderkey, coalesce(price, avg(price) OVER ()) AS price FROM g) SELECT o_orderkey, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) + 0e0 AS price FROM f",
    "scale_minmax": f"WITH {_GAPS}, f AS (SELECT o_orderkey, coalesce(price, avg(price) OVER ()) AS price FROM g) SELECT o_orderkey, round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 6) AS price FROM f",
    "prep_transform": _prep_transform(),
    "accuracy_by_scope": f"WITH {_GUESS} SELECT CASE WHEN is_ood THEN 'ood' ELSE 'id' END AS scope, 'accuracy' AS metric, round(avg(CAST(y = p AS DOUBLE)), 6) AS value FROM g GROUP BY is_ood",
    "f1_weighted": f"""WITH {_GUESS}, c AS (SELECT DISTINCT y AS c FROM g UNION SELECT DISTINCT p FROM g),
      k AS (SELECT c, count(*) FILTER (y = c) AS s, count(*) FILTER (p = c) AS q, count(*) FILTER (y = c AND p = c) AS t FROM c, g GROUP BY c)
      SELECT round(sum(CASE WHEN s + q > 0 THEN 2e0 * t / (s + q) ELSE 0 END * s) / sum(s), 6) AS value FROM k""",
    "rmse_mae_by_scope": """WITH g AS (SELECT l_extendedprice - l_quantity * 1500 AS d, CASE WHEN l_returnflag = 'R' THEN 'ood' ELSE 'id' END AS scope FROM lineitem)
      SELECT scope, 'rmse' AS metric, round(sqrt(avg(d * d)), 4) AS value FROM g GROUP BY scope UNION ALL SELECT scope, 'mae', round(avg(abs(d)), 4) FROM g GROUP BY scope""",
    "auroc": f"WITH {_roc()} SELECT round({_auroc()}, 8) AS value",
    "fpr_at_95tpr": f"WITH {_roc()} SELECT round({_fpr()}, 8) AS value",
    "roc_curve": f"WITH {_roc()} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, kept FROM roc",
    "hist_counts": f"WITH {_hist()} SELECT bin, round(p, 12) AS p, round(q, 12) AS q FROM h",
    "hist_js": f"WITH {_hist()} SELECT round({_js('h')}, 10) AS value",
    "hist_kl": f"WITH {_hist()} SELECT round({_kl('p', 'q', 'h')}, 10) AS value",
    "kl_priorities": f"WITH {_PRIORITIES} SELECT round({_kl('p', 'q', 'h')}, 10) AS value",
    "js_priorities": f"WITH {_PRIORITIES} SELECT round({_js('h')}, 10) AS value",
    "knn_var_metafeature": _knn(),
    "knn_metafeatures": _knn_metafeatures(),
    "knn_summaries": _knn_summaries(),
    "kmeans_lloyd_labels": _lloyd(),
    "logreg_scores": _logreg(),
    "ood_scores": """WITH r AS (SELECT vec_id, embedding, list_transform(embedding[1:3], lambda v: exp(CAST(v AS DOUBLE))) AS raw FROM embeddings)
      SELECT vec_id, round(1 - list_max(raw) / list_sum(raw), 9) AS by_probability, round(CAST(embedding[2] AS DOUBLE), 9) AS by_decision FROM r""",
    "nearest_centroid_pipeline": _pipeline(),
    "dataset_union_splits": "SELECT doc_id, NULL AS item_id, text, 'source' AS split_name FROM documents UNION ALL SELECT NULL, CAST(item_id AS VARCHAR), text, 'target' FROM benchmark",
    "dataset_summary": "SELECT 'texts' AS name, split_name, count(*) AS n_rows, CAST(5 AS INTEGER) AS n_features FROM (SELECT 'source' AS split_name FROM documents UNION ALL SELECT 'target' FROM benchmark) GROUP BY split_name",
    "dataset_parquet": "SELECT 'nations' AS name, CAST(NULL AS VARCHAR) AS split_name, count(*) AS n_rows, CAST(2 AS INTEGER) AS n_features, 'n_nationkey:int,n_name:string' AS feature_types FROM nation",
    "dataset_csv_splits": "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_nationkey, c_acctbal, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'source' ELSE 'target' END AS split_name FROM customer",
    "dataset_callable": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "dataset_config": "SELECT i, i * i / 4e0 AS square, i % 3 AS y, CAST(n_regionkey AS BIGINT) AS region FROM range(12) t(i) JOIN nation ON n_nationkey = i",
    "dataset_custom": "SELECT p AS package, CAST(length(p) AS INTEGER) AS y FROM (VALUES ('functions'), ('operators'), ('plans'), ('sources'), ('streaming')) t(p)",
    "rejected_arguments": """SELECT * FROM (VALUES
      ('abstract source', 'TypeError'),
      ('batch mode', 'ValueError: Unknown mode: nothing'),
      ('divergence', 'ValueError: Unknown divergence method: nothing'),
      ('empty partitions', (SELECT 'ValueError: segments: partitions [' || string_agg(i, ', ' ORDER BY i) || '] are empty.' FROM range(8) t(i) WHERE i >= (SELECT count(DISTINCT c_mktsegment) FROM customer))),
      ('feature', 'ValueError: Feature ''missing'' not in DataFrame columns'),
      ('metric task', 'ValueError: Unknown task: nothing'),
      ('path type', 'ValueError: path must be a string, a Path or a dict of split names to paths'),
      ('scaling', 'ValueError: Unknown scaling: nothing'),
      ('split mode', 'ValueError: Unknown mode: 9'),
      ('target', 'ValueError: Target column ''missing'' not found in dataset')) t("case", error)""",
    "row_ids": "SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS row_id FROM lineitem",
    "membership_semi_anti": "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'in' ELSE 'out' END AS side FROM orders",
    "index_set_algebra": """WITH a AS (SELECT DISTINCT user_id FROM events WHERE value > 5), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
      SELECT user_id, 'difference' AS kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, 'intersection' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""",
}
