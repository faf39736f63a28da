"""DuckDB statements that state the same results without any of the package's code.

The iterative jobs are unrolled into common table expressions, one per draw and per
round, by the small text builders at the top.
"""

from __future__ import annotations

from centroidal.operators.generate import uniform_centers
from checks.queries import (
    EMBEDDING_K,
    CENTERS_REST,
    FAR_AWAY,
    LINE_K,
    LOCAL_ROUNDS,
    MEASURES,
    OVERSAMPLING_ROUNDS,
    PREFIX_PARTS,
    RESTARTS,
    ROWS_PER_BUCKET,
    SAMPLE_ROWS,
    SETTLED,
    TIE_WIDTH,
)
from checks.tables import CLASS_NAMES, DROPPED_CLASS, PRIORITY_CLASS

LINE_D, EMBEDDING_D = len(MEASURES), 64
PRIME = 2147483647
# Rounds that are written out: the limit of the group fits, and more than the pool's fits and
# the fit with the stop rule take.  A fit that stops when nothing moves is followed by rounds
# that change nothing, so rounds beyond its last one do not matter.
POOL_SETTLED, FLAGSHIP_SETTLED, GLOBAL_SETTLED, EMBEDDING_SETTLED, SEEDS_SETTLED = 30, 40, 60, 40, 40


# --- text builders ---------------------------------------------------------------------


def rnd(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def hex_word(text: str, start: int, digits: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {start}, {digits}) AS BIGINT)"


def key_of(record_id: str) -> str:
    return hex_word(f"CAST({record_id} AS VARCHAR)", 1, 14)


def bucket_of(record_id: str, buckets: str) -> str:
    return f"CAST({hex_word(f'CAST({record_id} AS VARCHAR)', 15, 14)} % ({buckets}) AS INTEGER)"


def uniform(key: str, seed: str, draw: int) -> str:
    text = f"CAST({seed} AS VARCHAR) || ':{draw}'"
    s1, s2, s3, s4 = (hex_word(text, start, 7) for start in (1, 8, 15, 22))
    high, low = f"(({key}) >> 28)", f"(({key}) & 268435455)"
    z1 = f"((({high} + {s1}) * ({low} + {s2})) % {PRIME})"
    z2 = f"((({high} + {s3}) * ({low} + {s4})) % {PRIME})"
    return f"(({z1} + ({z2} + 0.5::DOUBLE) / {PRIME}::DOUBLE) / {PRIME}::DOUBLE)"


def sq(a: str, b: str, d: int) -> str:
    return "(" + " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, d + 1)) + ")"


def vector_avg(x: str, d: int) -> str:
    return "[" + ", ".join(f"avg({x}[{i}])" for i in range(1, d + 1)) + "]"


def coordinates(x: str, d: int) -> str:
    return ", ".join(f"{rnd(f'{x}[{i + 1}]')} AS c{i}" for i in range(d))


LINE_ID = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT))"

EMBEDDINGS = "pts AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
LINES = (
    "moments AS (SELECT "
    + ", ".join(f"avg({m}) AS m{i}, stddev_pop({m}) AS s{i}" for i, m in enumerate(MEASURES))
    + f" FROM lineitem), pts AS MATERIALIZED (SELECT {LINE_ID} AS id, ["
    + ", ".join(f"({m} - m{i}) / s{i}" for i, m in enumerate(MEASURES))
    + "] AS x, l_returnflag AS label FROM lineitem, moments)"
)


def start_centers(k: int, seed: int = 42, name: str = "c0") -> str:
    """k sampled rows, numbered in id order."""
    salted = hex_word(f"'{seed}:' || CAST(id AS VARCHAR)", 1, 14)
    return (
        f"{name}_picked AS (SELECT id, x FROM pts ORDER BY {salted}, id LIMIT {k}), "
        f"{name} AS MATERIALIZED (SELECT 0 AS g, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster,"
        f" x AS c, 0::BIGINT AS n, 0.0::DOUBLE AS sse FROM {name}_picked)"
    )


def assignment(name: str, points: str, centers: str, d: int) -> str:
    """Nearest centre per point within its group; the lowest index wins ties."""
    return (
        f"{name}_l AS (SELECT g, list(c ORDER BY cluster) AS cs FROM {centers} GROUP BY g), "
        f"{name}_d AS (SELECT p.*, list_transform(l.cs, lambda c: {sq('p.x', 'c', d)}) AS ds"
        f" FROM {points} p JOIN {name}_l l USING (g)), "
        f"{name} AS MATERIALIZED (SELECT * EXCLUDE (ds), list_min(ds) AS d2,"
        f" CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster FROM {name}_d)"
    )


def lloyd_round(name: str, points: str, centers: str, d: int) -> str:
    """New centres ``name`` (g, cluster, c, n, sse); n and sse refer to the old ones."""
    return (
        assignment(f"{name}_a", points, centers, d)
        + f", {name}_m AS (SELECT g, cluster, {vector_avg('x', d)} AS c, count(*) AS n, sum(d2) AS sse"
        f" FROM {name}_a GROUP BY g, cluster), "
        f"{name} AS MATERIALIZED (SELECT o.g, o.cluster, coalesce(m.c, o.c) AS c, coalesce(m.n, 0) AS n,"
        f" coalesce(m.sse, 0.0) AS sse FROM {centers} o LEFT JOIN {name}_m m ON o.g = m.g AND o.cluster = m.cluster)"
    )


def lloyd_rounds(prefix: str, points: str, centers: str, d: int, rounds: int) -> tuple[str, str]:
    parts, last = [], centers
    for i in range(1, rounds + 1):
        parts.append(lloyd_round(f"{prefix}{i}", points, last, d))
        last = f"{prefix}{i}"
    return ", ".join(parts), last


def seeds_of(prefix: str, points: str, d: int, k: int, seed: str) -> tuple[str, str]:
    """k-means++ races per group of ``points`` (g, key, x); ``seed`` may use g."""
    first = f"row_number() OVER (PARTITION BY g ORDER BY {uniform('key', seed, 0)}, key) = 1"
    parts = [f"{prefix}s0 AS MATERIALIZED (SELECT g, key, x FROM {points} QUALIFY {first})"]
    previous = f"(SELECT g, key, x, 'infinity'::DOUBLE AS d2 FROM {points})"
    for j in range(1, k):
        parts.append(
            f"{prefix}d{j} AS MATERIALIZED (SELECT p.g, p.key, p.x, least(p.d2, {sq('p.x', 's.x', d)}) AS d2"
            f" FROM {previous} p JOIN {prefix}s{j - 1} s ON p.g = s.g)"
        )
        race = f"row_number() OVER (PARTITION BY g ORDER BY -ln({uniform('key', seed, j)}) / d2, key) = 1"
        parts.append(f"{prefix}s{j} AS MATERIALIZED (SELECT g, key, x FROM {prefix}d{j} WHERE d2 > 0 QUALIFY {race})")
        previous = f"{prefix}d{j}"
    union = " UNION ALL ".join(
        f"SELECT g, {j} AS cluster, x AS c, 0::BIGINT AS n, 0.0::DOUBLE AS sse FROM {prefix}s{j}" for j in range(k)
    )
    parts.append(f"{prefix}s AS MATERIALIZED ({union})")
    return ", ".join(parts), f"{prefix}s"


def oversampled_seeds(points: str, d: int, k: int, seed: str, rounds: int) -> tuple[str, str]:
    """Sampled rows of each group of ``points`` (g, key, x), and a weighted race among them."""
    first = f"row_number() OVER (PARTITION BY g ORDER BY {uniform('key', seed, 0)}, key) = 1"
    parts = [
        f"o0 AS MATERIALIZED (SELECT g, key, x FROM {points} QUALIFY {first})",
        f"od0 AS MATERIALIZED (SELECT p.g, p.key, p.x, {sq('p.x', 's.x', d)} AS d2 FROM {points} p JOIN o0 s ON p.g = s.g)",
    ]
    for j in range(1, rounds + 1):
        chance = f"{uniform('key', seed, j)} * (sum(d2) OVER (PARTITION BY g)) < {2.0 * k} * d2"
        parts.append(f"o{j} AS MATERIALIZED (SELECT g, key, x FROM od{j - 1} QUALIFY d2 > 0 AND {chance})")
        parts.append(
            f"od{j} AS MATERIALIZED (SELECT p.g, p.key, p.x, least(p.d2, coalesce(list_min(list_transform(l.cs, lambda c: {sq('p.x', 'c', d)})), p.d2)) AS d2"
            f" FROM od{j - 1} p LEFT JOIN (SELECT g, list(x) AS cs FROM o{j} GROUP BY g) l ON l.g = p.g)"
        )
    union = " UNION ALL ".join(f"SELECT {j} AS r, g, key, x FROM o{j}" for j in range(rounds + 1))
    parts.append(
        "opool AS MATERIALIZED (SELECT g, key, x AS c, CAST(row_number() OVER (PARTITION BY g ORDER BY r, key) - 1 AS INTEGER) AS cluster"
        f" FROM ({union}))"
    )
    parts.append(assignment("oa", points, "opool", d))
    parts.append("ow AS MATERIALIZED (SELECT p.g, p.key, p.c AS x, (SELECT count(*) FROM oa WHERE oa.g = p.g AND oa.cluster = p.cluster) AS w FROM opool p)")
    previous = "(SELECT *, 1.0::DOUBLE AS d2 FROM ow)"
    for j in range(k):
        if j:
            known = "p.d2" if j > 1 else "'infinity'::DOUBLE"
            parts.append(
                f"owd{j} AS MATERIALIZED (SELECT p.g, p.key, p.x, p.w, least({known}, {sq('p.x', 's.x', d)}) AS d2"
                f" FROM {previous} p JOIN os{j - 1} s ON p.g = s.g)"
            )
            previous = f"owd{j}"
        race = f"row_number() OVER (PARTITION BY g ORDER BY -ln({uniform('key', seed, j)}) / (w * d2), key) = 1"
        parts.append(f"os{j} AS MATERIALIZED (SELECT g, key, x FROM {previous} WHERE w * d2 > 0 QUALIFY {race})")
    final = " UNION ALL ".join(f"SELECT g, {j} AS cluster, x AS c FROM os{j}" for j in range(k))
    parts.append(f"osum AS MATERIALIZED ({final})")
    return ", ".join(parts), "osum"


def fit_groups(prefix: str, points: str, d: int, k: int, seed: str, rounds: int) -> tuple[str, str, str]:
    """Seeds, rounds and a final assignment; returns (text, centres, assignment)."""
    seeding, start = seeds_of(prefix, points, d, k, seed)
    rounds_text, last = lloyd_rounds(f"{prefix}r", points, start, d, rounds)
    final = assignment(f"{prefix}f", points, last, d)
    return f"{seeding}, {rounds_text}, {final}", last, f"{prefix}f"


def group_totals(name: str, assigned: str) -> str:
    return f"{name} AS (SELECT g, count(*) AS n, sum(d2) AS sse FROM {assigned} GROUP BY g)"


POINTS_AS_ONE_GROUP = "one AS MATERIALIZED (SELECT 0 AS g, * FROM pts)"

BUCKETS = f"(SELECT greatest(4, count(*) // {ROWS_PER_BUCKET}) FROM lineitem)"


def settled_fit(start: str, written: int) -> str:
    """Rounds over ``one`` from ``start``; the ``chosen`` one is the first whose error is within SETTLED of the one before."""
    rounds, _ = lloyd_rounds("w", "one", start, LINE_D, written)
    union = " UNION ALL ".join(f"SELECT {i} AS i, cluster, c, n, sse FROM w{i}" for i in range(1, written + 1))
    return (
        f"{rounds}, every AS MATERIALIZED ({union}), "
        "totals AS (SELECT i, sum(sse) AS t FROM every GROUP BY i), "
        "changes AS (SELECT i, t, lag(t) OVER (ORDER BY i) AS before FROM totals), "
        f"stop AS MATERIALIZED (SELECT min(i) AS i FROM changes WHERE abs(t - before) <= {SETTLED} * greatest(t, before)), "
        "chosen AS MATERIALIZED (SELECT 0 AS g, cluster, c, 0::BIGINT AS n, 0.0::DOUBLE AS sse FROM every"
        " WHERE i = (SELECT i FROM stop)), "
        + assignment("fin", "one", "chosen", LINE_D)
    )


ITERATIONS = "CAST((SELECT i FROM stop) AS INTEGER) AS iterations, true AS converged"


def local_stage(random_seed: int = 42) -> tuple[str, str]:
    local, last, assigned_ = fit_groups("b", "bucketed", LINE_D, LINE_K, f"({random_seed} + g)", LOCAL_ROUNDS)
    return (
        f"WITH {LINES}, bucketed AS MATERIALIZED (SELECT {bucket_of('id', BUCKETS)} AS g, {key_of('id')} AS key, x FROM pts), "
        f"{local}, {group_totals('bucket_totals', assigned_)}"
    ), last


LOCAL_STAGE, _local_last = local_stage()
POOL = (
    f"pool AS MATERIALIZED (SELECT CAST(g AS BIGINT) * {LINE_K} + cluster AS id, g AS bucket, cluster, c AS x FROM {_local_last}), "
    f"copies AS MATERIALIZED (SELECT CAST(r.g AS INTEGER) AS g, {key_of('id')} AS key, x FROM pool, range({RESTARTS}) AS r(g))"
)


def restart_stage(random_seed: int = 42) -> tuple[str, str]:
    fit, last, assigned_ = fit_groups("p", "copies", LINE_D, LINE_K, f"({random_seed} + g)", POOL_SETTLED)
    return f"{local_stage(random_seed)[0]}, {POOL}, {fit}, {group_totals('restart_totals', assigned_)}", last


RESTART_STAGE, _pool_last = restart_stage()


def flagship(random_seed: int = 42) -> str:
    return (
        f"{restart_stage(random_seed)[0]}, winner AS (SELECT min(g) AS g FROM restart_totals"
        f" WHERE sse <= (SELECT min(sse) FROM restart_totals) * (1 + {TIE_WIDTH})), "
        f"seeded AS MATERIALIZED (SELECT 0 AS g, cluster, c, 0::BIGINT AS n, 0.0::DOUBLE AS sse"
        f" FROM {_pool_last} WHERE g = (SELECT g FROM winner)), {POINTS_AS_ONE_GROUP}, {settled_fit('seeded', FLAGSHIP_SETTLED)}"
    )


FLAGSHIP = flagship()


def every_seed(rows: str) -> str:
    """The statement for each of two seeds, with its repetition in place of {r} and its seed of {seed}."""
    return " UNION ALL ".join(
        f"SELECT * FROM ({flagship(42 + i)} {rows.replace('{r}', str(i + 1)).replace('{seed}', str(42 + i))})" for i in range(2)
    )


def runs_of(points: str) -> str:
    """The points once for each seed."""
    return (
        f"WITH {points}, runs AS MATERIALIZED (SELECT CAST(r.g AS INTEGER) AS g, {key_of('id')} AS key, x"
        f" FROM pts, range({RESTARTS}) AS r(g))"
    )


def _seed_rows(last: str, assigned_: str, further: str) -> str:
    return (
        f", {group_totals('totals', assigned_)},"
        f" sized AS (SELECT c.g, c.cluster, count(f.d2) AS n FROM {last} c LEFT JOIN {assigned_} f"
        " ON f.g = c.g AND f.cluster = c.cluster GROUP BY c.g, c.cluster)"
        f" SELECT CAST(42 + t.g AS BIGINT) AS seed, {rnd('t.sse')} AS sse,"
        " (SELECT string_agg(CAST(s.n AS VARCHAR), ';' ORDER BY s.cluster) FROM sized s WHERE s.g = t.g) AS cluster_counts,"
        f" t.g = (SELECT min(g) FROM totals WHERE sse <= (SELECT min(sse) FROM totals) * (1 + {TIE_WIDTH})) AS best,"
        f" true AS converged{further} FROM totals t"
    )


def best_of_seeds(points: str, d: int, k: int) -> str:
    """Fits that end when nothing moves: rounds beyond the last one do not matter."""
    fit, last, assigned_ = fit_groups("e", "runs", d, k, "(42 + g)", EMBEDDING_SETTLED)
    return f"{runs_of(points)}, {fit}{_seed_rows(last, assigned_, '')}"


def best_of_resting_seeds(points: str, d: int, k: int) -> str:
    """Fits that end with the first round in which no centre moves more than CENTERS_REST."""
    seeding, start = seeds_of("e", "runs", d, k, "(42 + g)")
    rounds, _ = lloyd_rounds("er", "runs", start, d, SEEDS_SETTLED)
    union = " UNION ALL ".join(
        [f"SELECT 0 AS i, g, cluster, c FROM {start}", *(f"SELECT {i}, g, cluster, c FROM er{i}" for i in range(1, SEEDS_SETTLED + 1))]
    )
    return (
        f"{runs_of(points)}, {seeding}, {rounds}, every AS MATERIALIZED ({union}), "
        f"moves AS (SELECT n.g, n.i, max({sq('n.c', 'o.c', d)}) AS moved FROM every n JOIN every o"
        " ON o.g = n.g AND o.cluster = n.cluster AND o.i = n.i - 1 GROUP BY n.g, n.i), "
        f"stop AS MATERIALIZED (SELECT g, min(i) AS i FROM moves WHERE moved <= {CENTERS_REST} GROUP BY g), "
        "chosen AS MATERIALIZED (SELECT e.g, e.cluster, e.c, 0::BIGINT AS n, 0.0::DOUBLE AS sse FROM every e JOIN stop s ON s.g = e.g AND s.i = e.i), "
        + assignment("ef", "runs", "chosen", d)
        + _seed_rows("chosen", "ef", ", CAST((SELECT s.i FROM stop s WHERE s.g = t.g) AS INTEGER) AS iterations")
    )


def agreement(moved: str, k: int) -> str:
    """Fingerprints of ``fin`` as it is and with other cluster numbers, compared field by field."""
    sides = []
    for name, cluster in (("l", "cluster"), ("r", moved)):
        sides.append(
            f"{name}_n AS (SELECT {cluster} AS c, count(*) AS n FROM fin GROUP BY 1), "
            f"{name} AS (SELECT (SELECT count(*) FROM fin) AS records, (SELECT max(len(x)) FROM fin) AS features,"
            f" {k} AS clusters, (SELECT list(coalesce(n, 0) ORDER BY i) FROM range({k}) AS t(i) LEFT JOIN {name}_n ON c = i)"
            " AS counts, (SELECT sum(d2) FROM fin) AS sse)"
        )
    same = {
        "same_records": "l.records = r.records",
        "same_features": "l.features = r.features",
        "same_clusters": "l.clusters = r.clusters",
        "same_cluster_counts": "l.counts = r.counts",
        "same_sse": "abs(l.sse - r.sse) <= greatest(1e-7 * greatest(l.sse, r.sse), 1e-6)",
    }
    fields = ", ".join(f"{test} AS {name}" for name, test in same.items())
    return f"{', '.join(sides)} SELECT {fields}, {' AND '.join(same.values())} AS agree FROM l, r"


def with_start(points: str, k: int, seed: int = 42) -> str:
    return f"WITH {points}, {POINTS_AS_ONE_GROUP}, {start_centers(k, seed)}"


def assigned(points: str, k: int, d: int) -> str:
    return f"{with_start(points, k)}, {assignment('fin', 'one', 'c0', d)}"


def model_rows(last: str, d: int, further: str = "") -> str:
    return (
        ", sizes AS (SELECT cluster, count(*) AS n FROM fin GROUP BY cluster)"
        f" SELECT c.cluster, coalesce(s.n, 0) AS n, {coordinates('c.c', d)},"
        f" {rnd('(SELECT sum(d2) FROM fin)', 4)} AS total_sse{further}"
        f" FROM {last} c LEFT JOIN sizes s ON c.cluster = s.cluster"
    )


def long_rows(keys: str, vector: str, d: int, source: str) -> str:
    return (
        f" SELECT {keys}, CAST(i - 1 AS INTEGER) AS dim, {rnd(f'{vector}[i]')} AS value"
        f" FROM {source}, range(1, {d + 1}) AS dims(i)"
    )


LINE_FIT = f"{with_start(LINES, LINE_K)}, {settled_fit('c0', GLOBAL_SETTLED)}"
_emb_rounds, _emb_last = lloyd_rounds("w", "one", "c0", EMBEDDING_D, EMBEDDING_SETTLED)


def history() -> str:
    rows = []
    previous = "c0"
    for i in range(1, GLOBAL_SETTLED + 1):
        rows.append(
            f"SELECT {i} AS iteration, {rnd('sum(n.sse)', 4)} AS sse,"
            f" {rnd('max(' + sq('o.c', 'n.c', LINE_D) + ')')} AS max_center_shift,"
            " string_agg(CAST(n.n AS VARCHAR), ';' ORDER BY n.cluster) AS cluster_counts"
            f" FROM w{i} n JOIN {previous} o ON o.cluster = n.cluster"
        )
        previous = f"w{i}"
    return f"{LINE_FIT} SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE iteration <= (SELECT i FROM stop)"


def quality(source: str, label: str, cluster: str) -> str:
    """ARI from pair counts, NMI from probabilities with joined marginals, purity."""
    return (
        f"cells AS MATERIALIZED (SELECT {label} AS a, {cluster} AS b, count(*)::DOUBLE AS n FROM {source} GROUP BY 1, 2), "
        "ra AS (SELECT a, sum(n) AS n FROM cells GROUP BY a), rb AS (SELECT b, sum(n) AS n, max(n) AS top FROM cells GROUP BY b), "
        "tot AS (SELECT sum(n) AS n FROM cells), "
        "pairs AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS ij, (SELECT sum(n * (n - 1) / 2) FROM ra) AS i,"
        " (SELECT sum(n * (n - 1) / 2) FROM rb) AS j, (SELECT n * (n - 1) / 2 FROM tot) AS every), "
        "ent AS (SELECT (SELECT -sum(ra.n / tot.n * ln(ra.n / tot.n)) FROM ra, tot) AS ha,"
        " (SELECT -sum(rb.n / tot.n * ln(rb.n / tot.n)) FROM rb, tot) AS hb,"
        " (SELECT sum(cells.n / tot.n * ln(cells.n * tot.n / (ra.n * rb.n)))"
        " FROM cells JOIN ra USING (a) JOIN rb USING (b), tot) AS mi), "
        "q AS (SELECT (ij - i * j / every) / ((i + j) / 2 - i * j / every) AS ari, mi / ((ha + hb) / 2) AS nmi,"
        " (SELECT sum(top) FROM rb) / tot.n AS purity, CAST(tot.n AS BIGINT) AS num_records,"
        " (SELECT count(*) FROM ra) AS num_classes, (SELECT count(*) FROM rb) AS num_clusters FROM pairs, ent, tot)"
    )


QUALITY_COLUMNS = (
    f"{rnd('ari')} AS ari, {rnd('nmi')} AS nmi, {rnd('purity')} AS purity, num_records, num_classes, num_clusters"
)
EMBEDDING_QUALITY = f"{assigned(EMBEDDINGS, EMBEDDING_K, EMBEDDING_D)}, {quality('fin', 'label', 'cluster')}"

_case = "CASE label " + " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in PRIORITY_CLASS.items()) + " END"
ORDERS = (
    "noisy AS (SELECT o_orderkey AS record_id, '  ' || o_orderpriority || '..' AS raw, o_orderstatus, o_totalprice,"
    " CAST(year(o_orderdate) AS DOUBLE) AS year, 7.5::DOUBLE AS constant FROM orders), "
    "clean AS (SELECT *, regexp_replace(trim(raw), '\\.+$', '') AS label FROM noisy), "
    f"mapped AS MATERIALIZED (SELECT *, {_case} AS category FROM clean), "
    f"kept AS MATERIALIZED (SELECT * FROM mapped WHERE category <> '{DROPPED_CLASS}')"
)


def code(column: str, source: str = "kept") -> str:
    return (
        f"(SELECT {column} AS v, CAST(dense_rank() OVER (ORDER BY {column}) - 1 AS INTEGER) AS code"
        f" FROM (SELECT DISTINCT {column} FROM {source}))"
    )


def scaled(column: str, part: str = "") -> str:
    window = f"OVER ({part})"
    return (
        f"CASE WHEN min({column}) {window} = max({column}) {window} THEN 0.0"
        f" ELSE ({column} - avg({column}) {window}) / stddev_pop({column}) {window} END"
    )


LABEL_ID = "CASE category " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(CLASS_NAMES)) + " END"

EVENTS = (
    "trials AS (SELECT event_type AS configuration, CAST(hour(ts) AS INTEGER) AS size, user_id AS iterations,"
    " value * value AS sse, value AS total_runtime_seconds, value < 100 AS converged FROM events)"
)


def mean_std(measure: str) -> str:
    return (
        f"{rnd(f'avg({measure})', 4)} AS mean_{measure},"
        f" {rnd(f'coalesce(stddev_samp({measure}), 0.0)', 4)} AS std_{measure}"
    )


def blob_noise(seed: int, index: int) -> str:
    first = 2 * (index // 2) + 1
    wave = "cos" if index % 2 == 0 else "sin"
    return (
        f"sqrt(-2.0::DOUBLE * ln({uniform('key', str(seed), first)}))"
        f" * {wave}(2.0::DOUBLE * pi() * {uniform('key', str(seed), first + 1)})"
    )


def balanced(k: int) -> str:
    """Cumulative sizes, not the closed form: row i belongs to the first cluster whose end exceeds i."""
    return (
        "total AS (SELECT count(*) AS n FROM orders), "
        f"ends AS (SELECT CAST(j AS INTEGER) AS label, sum(n // {k} + CASE WHEN j < n % {k} THEN 1 ELSE 0 END)"
        f" OVER (ORDER BY j) AS e FROM range({k}) AS r(j), total), "
        f"ids AS (SELECT o_orderkey AS record_id, {key_of('o_orderkey')} AS key,"
        " (SELECT min(label) FROM ends WHERE e > o_orderkey) AS label FROM orders)"
    )


def mixed(k: int) -> str:
    block_key = key_of(f"(o_orderkey // {k})")
    turn = f"CAST(floor({uniform(block_key, '42', 0)} * {k}) AS BIGINT)"
    return (
        f"ids AS (SELECT o_orderkey AS record_id, {key_of('o_orderkey')} AS key,"
        f" CAST((o_orderkey + {turn}) % {k} AS INTEGER) AS label FROM orders)"
    )


def uniform_center(k: int, d: int, index: int) -> str:
    values = ", ".join(f"{float(v)!r}::DOUBLE" for v in uniform_centers(k, d, 42)[:, index])
    return f"[{values}][label + 1]"


SIZES = f"sizes AS (SELECT unnest([{', '.join(f'(SELECT count(*) // {p} FROM orders)' for p in PREFIX_PARTS)}]) AS size)"

LINE_COLUMNS = ", ".join(MEASURES)


def sql() -> dict[str, str]:
    line_assigned = assigned(LINES, LINE_K, LINE_D)
    embedding_assigned = assigned(EMBEDDINGS, EMBEDDING_K, EMBEDDING_D)
    first_round = f"{with_start(LINES, LINE_K)}, {lloyd_round('c1', 'one', 'c0', LINE_D)}"
    far = "[" + ", ".join(f"{v}::DOUBLE" for v in FAR_AWAY) + "]"
    far_start = (
        f"{with_start(LINES, LINE_K)}, far AS MATERIALIZED (SELECT g, cluster, c, n, sse FROM c0 UNION ALL"
        f" SELECT 0, {LINE_K}, {far}, 0::BIGINT, 0.0::DOUBLE)"
    )
    seed_runs = runs_of(EMBEDDINGS)
    over_seeds, over_start = oversampled_seeds("runs", EMBEDDING_D, EMBEDDING_K, "(42 + g)", OVERSAMPLING_ROUNDS)
    emb_seeds, emb_start = seeds_of("e", "runs", EMBEDDING_D, EMBEDDING_K, "(42 + g)")

    queries = {
        "sq_distance": f"WITH {EMBEDDINGS}, lead AS (SELECT label, arg_min(x, id) AS y FROM pts GROUP BY label)"
        f" SELECT id AS record_id, {rnd(sq('x', 'y', EMBEDDING_D))} AS distance_sq FROM pts JOIN lead USING (label)",
        "pack_unpack": f"SELECT {LINE_ID} AS record_id, "
        + ", ".join(f"{m} AS f{i}" for i, m in enumerate(MEASURES))
        + " FROM lineitem",
        "uniform_draws": f"SELECT o_orderkey, {key_of('o_orderkey')} AS key, "
        + ", ".join(f"{rnd(uniform(key_of('o_orderkey'), '42', j), 9)} AS u{j}" for j in range(3))
        + " FROM orders",
        "assign_nearest": f"{embedding_assigned} SELECT id AS record_id, cluster, {rnd('d2')} AS distance_sq FROM fin",
        "assign_lines": f"{line_assigned} SELECT id AS record_id, cluster, {rnd('d2')} AS distance_sq FROM fin",
        "cluster_means": f"WITH {EMBEDDINGS}, m AS (SELECT label AS cluster, count(*) AS n,"
        f" {vector_avg('x', EMBEDDING_D)} AS c FROM pts GROUP BY label)"
        + long_rows("cluster, n", "c", EMBEDDING_D, "m"),
        "cluster_statistics": f"{line_assigned} SELECT cluster, count(*) AS n, {rnd('sum(d2)', 4)} AS sse, "
        + ", ".join(f"{rnd(f'sum(x[{i + 1}])', 4)} AS s{i}" for i in range(LINE_D))
        + " FROM fin GROUP BY cluster",
        "lloyd_step": f"{first_round} SELECT c1.cluster, c1.n, {coordinates('c1.c', LINE_D)},"
        f" {rnd('(SELECT sum(sse) FROM c1)', 4)} AS step_sse,"
        f" {rnd('max(' + sq('c0.c', 'c1.c', LINE_D) + ') OVER ()')} AS max_center_shift"
        " FROM c1 JOIN c0 ON c0.cluster = c1.cluster",
        "empty_cluster_kept": f"{far_start}, {lloyd_round('c1', 'one', 'far', LINE_D)}"
        f" SELECT cluster, n, {coordinates('c', LINE_D)} FROM c1",
        "max_center_shift": f"{first_round} SELECT {rnd('max(' + sq('c0.c', 'c1.c', LINE_D) + ')')} AS max_center_shift"
        " FROM c1 JOIN c0 ON c0.cluster = c1.cluster",
        "sse_of_assignment": f"{with_start(EMBEDDINGS, EMBEDDING_K)} SELECT {rnd('sum(' + sq('x', 'c', EMBEDDING_D) + ')')} AS sse"
        " FROM one JOIN c0 ON c0.cluster = one.label",
        "evaluate_centers": f"{far_start}, {assignment('fin', 'one', 'far', LINE_D)} SELECT far.cluster,"
        f" count(fin.d2) AS n, {rnd('coalesce(sum(fin.d2), 0.0)', 4)} AS sse"
        " FROM far LEFT JOIN fin ON fin.cluster = far.cluster GROUP BY far.cluster",
        "cluster_sizes": f"{embedding_assigned} SELECT c0.cluster, count(fin.d2) AS n FROM c0"
        " LEFT JOIN fin ON fin.cluster = c0.cluster GROUP BY c0.cluster",
        "lloyd_fit": LINE_FIT + model_rows("chosen", LINE_D, f", {ITERATIONS}"),
        "lloyd_settles": LINE_FIT + model_rows("chosen", LINE_D, f", {ITERATIONS}"),
        "lloyd_history": history(),
        "lloyd_fit_embeddings": f"{with_start(EMBEDDINGS, EMBEDDING_K)}, {_emb_rounds}"
        + long_rows("cluster, true AS converged", "c", EMBEDDING_D, _emb_last),
        "kmeanspp_seeds": f"{seed_runs}, {emb_seeds}"
        + long_rows("CAST(42 + g AS INTEGER) AS seed, cluster", "c", EMBEDDING_D, emb_start),
        "oversampled_seeds": f"{seed_runs}, {over_seeds}"
        + long_rows("CAST(42 + g AS INTEGER) AS seed, cluster", "c", EMBEDDING_D, over_start),
        "bucket_counts": f"SELECT {bucket_of(LINE_ID, BUCKETS)} AS bucket, count(*) AS n FROM lineitem GROUP BY 1",
        "partition_counts": f"WITH found AS (SELECT {bucket_of(LINE_ID, BUCKETS)} AS b, count(*) AS n FROM lineitem GROUP BY 1)"
        f" SELECT CAST(i AS INTEGER) AS partition, coalesce(n, 0) AS records FROM range({BUCKETS}) AS r(i)"
        " LEFT JOIN found ON b = i",
        "bucket_local_kmeans": f"{LOCAL_STAGE} SELECT CAST(c.g AS BIGINT) AS bucket, t.n AS record_count,"
        f" {rnd('t.sse', 4)} AS sse, c.cluster, {coordinates('c.c', LINE_D)}"
        f" FROM {_local_last} c JOIN bucket_totals t ON t.g = c.g",
        "candidate_pool": f"{LOCAL_STAGE}, {POOL} SELECT id AS record_id, CAST(bucket AS BIGINT) AS bucket, cluster,"
        f" t.n AS record_count, {coordinates('x', LINE_D)} FROM pool JOIN bucket_totals t ON t.g = pool.bucket",
        "candidate_restarts": f"{RESTART_STAGE} SELECT CAST(42 + g AS BIGINT) AS seed, n AS record_count,"
        f" {rnd('sse')} AS sse FROM restart_totals",
        "parallel_kmeans": FLAGSHIP + model_rows("chosen", LINE_D, f", {ITERATIONS}"),
        "parallel_kmeans_partitions": FLAGSHIP + model_rows("chosen", LINE_D, f", {ITERATIONS}"),
        "multi_init_kmeans": best_of_seeds(EMBEDDINGS, EMBEDDING_D, EMBEDDING_K),
        "multi_init_distributed": best_of_resting_seeds(LINES, LINE_D, LINE_K),
        "best_of_runs": f"WITH {EVENTS}, runs AS (SELECT size AS run, round(avg(sse), 1) AS sse FROM trials GROUP BY size)"
        " SELECT run, sse FROM runs ORDER BY sse, run LIMIT 1",
        "predict_labeled": f"{embedding_assigned} SELECT id AS record_id, label, cluster FROM fin",
        "labeled_run": f"{FLAGSHIP} SELECT f.label, f.cluster, count(*) AS n, {ITERATIONS} FROM fin f GROUP BY f.label, f.cluster",
        "labeled_predictions": every_seed(
            "SELECT 'lines' AS dataset_name, {r} AS repetition, {seed}::BIGINT AS random_seed, id AS record_id, label AS true_label,"
            " cluster AS predicted_cluster FROM fin"
        ),
        "contingency": f"{line_assigned} SELECT label, cluster, count(*) AS n FROM fin GROUP BY label, cluster",
        "purity": f"{EMBEDDING_QUALITY} SELECT {rnd('purity')} AS purity FROM q",
        "ari": f"{EMBEDDING_QUALITY} SELECT {rnd('ari')} AS ari FROM q",
        "nmi": f"{EMBEDDING_QUALITY} SELECT {rnd('nmi')} AS nmi FROM q",
        "cardinalities": f"{EMBEDDING_QUALITY} SELECT num_records, num_classes, num_clusters FROM q",
        "quality_row": f"{line_assigned}, {quality('fin', 'label', 'cluster')} SELECT {QUALITY_COLUMNS} FROM q",
        "quality_of_text_labels": f"WITH {quality('orders', 'o_orderpriority', 'o_orderstatus')}"
        f" SELECT {QUALITY_COLUMNS} FROM q",
        "cross_check": f"{line_assigned}, {agreement('cluster', LINE_K)}",
        "cross_check_renumbered": f"{line_assigned}, "
        + agreement(f"CASE WHEN cluster = 0 THEN {LINE_K} ELSE cluster END", LINE_K + 1),
        "normalize_label": f"WITH {ORDERS} SELECT record_id, label FROM clean",
        "map_category": f"WITH {ORDERS} SELECT record_id, label, category FROM mapped",
        "unmapped_labels": f"WITH {ORDERS} SELECT DISTINCT label FROM mapped WHERE category <> 'fast'",
        "drop_class": f"WITH {ORDERS} SELECT record_id, category FROM kept",
        "drop_report": f"WITH {ORDERS} SELECT count(*) AS rows_raw,"
        f" count(*) FILTER (category = '{DROPPED_CLASS}') AS rows_dropped,"
        f" count(*) FILTER (category <> '{DROPPED_CLASS}') AS rows_final FROM mapped",
        "ordinal_encode": f"WITH {ORDERS} SELECT record_id, a.code AS label, b.code AS o_orderstatus FROM kept"
        f" JOIN {code('label')} a ON a.v = kept.label JOIN {code('o_orderstatus')} b ON b.v = kept.o_orderstatus",
        "encode_label": f"WITH {ORDERS} SELECT record_id, CAST({LABEL_ID} AS BIGINT) AS label FROM mapped",
        "standardize": f"WITH {LINES} SELECT id AS record_id, "
        + ", ".join(f"{rnd(f'x[{i + 1}]')} AS {m}" for i, m in enumerate(MEASURES))
        + " FROM pts",
        "validate_points": f"WITH {EMBEDDINGS} SELECT count(*) AS rows, CAST(min(len(x)) AS INTEGER) AS min_features,"
        " CAST(max(len(x)) AS INTEGER) AS max_features,"
        " count(*) FILTER (len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) > 0) AS invalid_rows,"
        " count(label) AS labeled_rows, count(DISTINCT label) AS classes FROM pts",
        "class_histogram": "SELECT l_returnflag AS label, count(*) AS rows FROM lineitem GROUP BY 1",
        "nested_prefixes": f"WITH {ORDERS}, {SIZES} SELECT CAST(size AS BIGINT) AS size, record_id, "
        + ", ".join(
            f"{rnd(scaled(c, 'PARTITION BY size'))} AS {c}" for c in ("o_totalprice", "year", "constant")
        )
        + " FROM noisy JOIN sizes ON record_id < size",
        "exact_sample": f"SELECT record_id, {LINE_COLUMNS} FROM (SELECT {LINE_ID} AS record_id, {LINE_COLUMNS} FROM lineitem)"
        f" ORDER BY md5('42:' || record_id)[1:14], record_id LIMIT {SAMPLE_ROWS}",
        "record_ids": "SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1"
        " AS record_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem",
        "prep_summary": f"WITH {ORDERS} SELECT 'rows_raw' AS metric, count(*) AS value FROM mapped"
        f" UNION ALL SELECT 'rows_dropped', count(*) FROM mapped WHERE category = '{DROPPED_CLASS}'"
        " UNION ALL SELECT 'rows_final', count(*) FROM kept UNION ALL SELECT 'features', 4"
        " UNION ALL SELECT 'classes', count(DISTINCT category) FROM kept"
        " UNION ALL SELECT 'difference_to_expected', count(*) - 10000 FROM kept"
        " UNION ALL SELECT 'rows_' || category, count(*) FROM kept GROUP BY category",
        "prepare_orders": f"WITH {ORDERS}, coded AS (SELECT *, s.code::DOUBLE AS status FROM kept JOIN {code('o_orderstatus')} s"
        " ON s.v = kept.o_orderstatus) SELECT record_id, "
        + ", ".join(f"{rnd(scaled(c))} AS c{i}" for i, c in enumerate(("status", "o_totalprice", "year", "constant")))
        + f", CAST({LABEL_ID} AS BIGINT) AS label FROM coded",
        "points_csv_round_trip": "SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber,"
        " l_extendedprice) - 1 AS record_id, " + ", ".join(f"{m} AS f{i}" for i, m in enumerate(MEASURES)) + " FROM lineitem",
        "labeled_csv_round_trip": f"WITH {EMBEDDINGS}, placed AS (SELECT row_number() OVER (ORDER BY id % 2, id) - 1 AS record_id,"
        " CAST(label AS BIGINT) AS label, x FROM pts)" + long_rows("record_id, label", "x", EMBEDDING_D, "placed"),
        "parquet_round_trip": f"WITH {EMBEDDINGS} SELECT CAST(label AS BIGINT) AS label, CAST(i - 1 AS INTEGER) AS dim,"
        f" count(*) AS n, {rnd('sum(x[i])')} AS total FROM pts, range(1, {EMBEDDING_D + 1}) AS r(i) GROUP BY label, i",
        "features_labels_split": f"WITH {LINES} SELECT id AS record_id, {coordinates('x', LINE_D)}, label FROM pts",
        "write_sample": f"WITH {LINES}, picked AS (SELECT * FROM pts ORDER BY md5('42:' || id)[1:14], id LIMIT {SAMPLE_ROWS})"
        " SELECT " + ", ".join(f"{rnd(f'x[{i + 1}]', 5)} AS f{i}" for i in range(LINE_D)) + ", label FROM picked",
        "trials_round_trip": f"WITH {EVENTS} SELECT configuration AS dataset_name, 2 * count(*) AS n,"
        f" 2 * count(*) FILTER (converged) AS converged_runs, {rnd('2 * sum(total_runtime_seconds)', 4)} AS seconds,"
        " CAST(2 * sum(iterations) AS BIGINT) AS last_counts FROM trials GROUP BY configuration",
        "trials_appended_once": "SELECT CAST(event_id AS VARCHAR) AS experiment_id, event_type AS dataset_name,"
        " event_id AS num_records, 4::INTEGER AS num_features, 3::INTEGER AS num_clusters, 8::INTEGER AS num_partitions,"
        " 'local[1]' AS spark_master, user_id AS random_seed, 100::INTEGER AS local_max_iterations,"
        " 50::INTEGER AS global_max_iterations, 1e-6::DOUBLE AS local_tolerance, 1e-4::DOUBLE AS global_cost_tolerance,"
        " 5::INTEGER AS aggregation_restarts, event_id AS materialized_record_count, value < 100 AS converged,"
        " CAST(user_id AS INTEGER) AS iterations, value * value AS sse, user_id || ';0;' || event_id AS cluster_counts,"
        " value AS partition_clustering_seconds, value / 2 AS center_aggregation_seconds,"
        " value / 4 AS initialization_seconds, value * 2 AS global_clustering_seconds,"
        " value / 8 AS final_evaluation_seconds, value * 4 AS total_runtime_seconds FROM events",
        "write_predictions": f"WITH {EMBEDDINGS}, {POINTS_AS_ONE_GROUP}, {start_centers(EMBEDDING_K, 42, 'c42')},"
        f" {start_centers(EMBEDDING_K, 43, 'c43')}, {assignment('f1', 'one', 'c42', EMBEDDING_D)},"
        f" {assignment('f2', 'one', 'c43', EMBEDDING_D)}"
        + " UNION ALL ".join(
            f" SELECT 'vectors' AS dataset_name, {r} AS repetition, {41 + r}::BIGINT AS random_seed, id AS record_id,"
            f" label AS true_label, cluster AS predicted_cluster FROM f{r}"
            for r in (1, 2)
        ),
        "exact_partitions": " UNION ALL ".join(
            f"SELECT {n} AS wanted, {n}::BIGINT AS partitions, count(*) AS records FROM lineitem" for n in (1, 6, 11)
        ),
        "quality_table_round_trip": "SELECT o_orderpriority AS dataset,"
        " CASE WHEN o_orderstatus = 'P' THEN 'traditional_kmeans' ELSE 'parallel_kmeans' END AS algorithm,"
        " CASE WHEN o_orderstatus = 'F' THEN 'local[2]' ELSE 'local[1]' END AS master,"
        f" {rnd('avg(o_totalprice) / 1000000')} AS purity, {rnd('min(o_totalprice) / 1000000')} AS ari,"
        f" {rnd('max(o_totalprice) / 1000000')} AS nmi, {rnd('avg(o_totalprice) / 1000')} AS elapsed_seconds,"
        " 6::BIGINT AS members, true AS converged FROM orders GROUP BY o_orderpriority, o_orderstatus",
        "prepare_kdd_files": "WITH kept AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1"
        " WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 END AS label, o_totalprice, o_orderstatus,"
        " year(o_orderdate) AS y, o_custkey FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'),"
        " coded AS (SELECT label, o_totalprice AS a, dense_rank() OVER (ORDER BY o_orderstatus) AS b,"
        " dense_rank() OVER (ORDER BY y) AS c, o_custkey AS e FROM kept),"
        " z AS (SELECT label, " + ", ".join(f"{scaled(v)} AS {v}" for v in "abce") + " FROM coded)"
        f" SELECT CAST(label AS BIGINT) AS label, count(*) AS n, {rnd('avg(abs(a) + abs(b) + abs(c) + abs(e))')} AS mean_size,"
        f" {rnd('avg(a)')} AS m0, {rnd('avg(b)')} AS m1, {rnd('avg(c)')} AS m2, 0.0::DOUBLE AS m3, {rnd('avg(e)')} AS m4"
        " FROM z GROUP BY label",
        "trial_runs": every_seed(
            ", member AS (SELECT c.cluster, count(f.d2) AS m, coalesce(sum(f.d2), 0.0) AS e FROM chosen c LEFT JOIN fin f"
            " ON f.cluster = c.cluster GROUP BY c.cluster), whole AS (SELECT CAST(sum(m) AS BIGINT) AS n, sum(e) AS e,"
            " string_agg(CAST(m AS VARCHAR), ';' ORDER BY cluster) AS cluster_counts FROM member),"
            " parts AS (SELECT CAST(count(*) AS INTEGER) AS p FROM bucket_totals)"
            f" SELECT 'lines-n' || n || '-k{LINE_K}-r{{r}}' AS experiment_id, 'lines' AS dataset_name, n AS num_records,"
            f" {LINE_D} AS num_features, {LINE_K} AS num_clusters, p AS num_partitions,"
            f" {{seed}}::BIGINT AS random_seed, {LOCAL_ROUNDS} AS local_max_iterations, 100 AS global_max_iterations,"
            f" {RESTARTS} AS aggregation_restarts, n AS materialized_record_count, true AS converged,"
            f" CAST(i AS INTEGER) AS iterations, {rnd('e', 4)} AS sse, cluster_counts FROM whole, parts, stop"
        ),
        "trial_summary": f"WITH {EVENTS} SELECT configuration, count(*) AS repetitions,"
        " count(*) FILTER (converged) AS converged_runs,"
        f" {rnd('avg(CAST(converged AS INTEGER))')} AS convergence_rate, {mean_std('iterations')}, {mean_std('sse')},"
        f" {mean_std('total_runtime_seconds')} FROM trials GROUP BY configuration",
        "convergence_rate": f"WITH {EVENTS} SELECT configuration, size,"
        f" {rnd('avg(CAST(converged AS INTEGER))')} AS convergence_rate FROM trials GROUP BY configuration, size",
        "speedup": f"WITH {EVENTS}, s AS (SELECT size, configuration, avg(total_runtime_seconds) AS t FROM trials GROUP BY 1, 2),"
        " b AS (SELECT size, t AS base FROM s WHERE configuration = 'click')"
        f" SELECT s.size, configuration, {rnd('base / t')} AS speedup, {rnd('(1 - t / base) * 100')} AS runtime_reduction_percent"
        " FROM s LEFT JOIN b USING (size)",
        "quality_comparison": "WITH m AS (SELECT o_orderpriority AS dataset, o_orderstatus AS s, avg(o_totalprice) / 1000 AS t,"
        " avg(o_totalprice) / 1000000 AS purity, min(o_totalprice) / 1000000 AS ari, max(o_totalprice) / 1000000 AS nmi"
        " FROM orders GROUP BY 1, 2) SELECT b.dataset, 'local[1]' AS base_master,"
        f" {rnd('b.t')} AS base_seconds, 'local[2]' AS comparison_master, {rnd('o.t')} AS comparison_seconds,"
        f" {rnd('b.t / o.t')} AS speedup, {rnd('b.purity')} AS parallel_purity, {rnd('b.ari')} AS parallel_ari,"
        f" {rnd('b.nmi')} AS parallel_nmi, {rnd('l.t')} AS baseline_seconds, {rnd('l.purity')} AS baseline_purity,"
        f" {rnd('l.ari')} AS baseline_ari, {rnd('l.nmi')} AS baseline_nmi, {rnd('b.purity - l.purity')} AS purity_gap,"
        f" {rnd('b.ari - l.ari')} AS ari_gap, {rnd('b.nmi - l.nmi')} AS nmi_gap"
        " FROM m b JOIN m o ON o.dataset = b.dataset AND o.s = 'F' JOIN m l ON l.dataset = b.dataset AND l.s = 'P'"
        " WHERE b.s = 'O'",
        "balanced_sizes": f"WITH {balanced(7)} SELECT label, count(*) AS n, min(record_id) AS first, max(record_id) AS last"
        " FROM ids GROUP BY label",
        "zero_spread_blobs": f"WITH {balanced(5)} SELECT record_id, label, "
        + ", ".join(f"label * 10.0::DOUBLE + {i} AS c{i}" for i in range(4))
        + " FROM ids",
        "diagonal_blobs": f"WITH {balanced(5)} SELECT record_id, label, "
        + ", ".join(f"{rnd(f'label * 10.0::DOUBLE + {i} + 1.5::DOUBLE * {blob_noise(42, i)}')} AS c{i}" for i in range(4))
        + " FROM ids",
        "uniform_blobs": f"WITH {mixed(5)} SELECT label, count(*) AS n, "
        + ", ".join(f"{rnd(f'avg({uniform_center(5, 20, i)} + {blob_noise(42, i)})')} AS m{i}" for i in range(20))
        + " FROM ids GROUP BY label",
        "size_ladder": f"WITH {mixed(5)}, wide AS (SELECT record_id, label, "
        + ", ".join(f"{uniform_center(5, 4, i)} + {blob_noise(42, i)} AS f{i}" for i in range(4))
        + f" FROM ids), {SIZES}, z AS (SELECT size, label, "
        + ", ".join(f"{scaled(f'f{i}', 'PARTITION BY size')} AS f{i}" for i in range(4))
        + " FROM wide JOIN sizes ON record_id < size) SELECT CAST(size AS BIGINT) AS size, label, count(*) AS n, "
        + ", ".join(f"{rnd(f'avg(f{i})')} AS f{i}" for i in range(4))
        + " FROM z GROUP BY size, label",
    }
    return queries
