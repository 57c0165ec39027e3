"""Named queries, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# --- fragments shared by the SQL side -------------------------------------------------

def sub(label: str = "p_type") -> str:
    return f"""sub AS (SELECT DISTINCT l_orderkey AS id, {label} AS label
        FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def assigned(label: str = "p_type") -> str:
    return sub(label) + """,
    ids AS (SELECT id, o_orderpriority AS cluster FROM (SELECT DISTINCT id FROM sub) JOIN orders ON id = o_orderkey)"""


def cells(label: str = "p_type") -> str:
    return assigned(label) + """,
    cl AS (SELECT cluster, count(*) AS n_in FROM ids GROUP BY cluster),
    lb AS (SELECT label, count(*) AS n_pos FROM sub JOIN ids USING (id) GROUP BY label),
    hit AS (SELECT cluster, label, count(*) AS a FROM sub JOIN ids USING (id) GROUP BY cluster, label),
    tot AS (SELECT count(*) AS n FROM ids),
    cell AS (SELECT cluster, label, coalesce(a, 0) AS a, n_pos - coalesce(a, 0) AS b, n_in - coalesce(a, 0) AS c,
        n - n_in - n_pos + coalesce(a, 0) AS d, n_in, n
        FROM cl CROSS JOIN lb CROSS JOIN tot LEFT JOIN hit USING (cluster, label))"""


def profiles(label: str = "p_type") -> str:
    return sub(label) + """,
    sets AS (SELECT id, list_sort(list(label)) AS labels FROM sub GROUP BY id),
    pr AS (SELECT labels, count(*) AS mult, min(id) AS pid FROM sets GROUP BY labels)"""


def jaccard_nn(k: int, label: str = "p_type") -> str:
    return profiles(label) + f""",
    pd AS (SELECT a.pid AS i, b.pid AS j,
        1.0::DOUBLE - len(list_intersect(a.labels, b.labels))::DOUBLE / len(list_distinct(list_concat(a.labels, b.labels))) AS d
        FROM pr a JOIN pr b ON a.pid <> b.pid),
    nn AS (SELECT * FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY round(d, 11), j) AS rank FROM pd) t
        WHERE rank <= {k})"""


def embedded_nn(k: int) -> str:
    return f"""e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS cluster FROM embeddings),
    nn AS (SELECT * FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY round(d, 11), j) AS rank FROM (
        SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.id <> b.id)) t
        WHERE rank <= {k})"""


def graph(mode: str = "union", divisor: float = 2.0, mult: bool = False, floor: str = "1e-12") -> str:
    votes = "WHERE votes = 2" if mode == "mutual" else ""
    weight = f"exp(-(d * d) / ({divisor}::DOUBLE * sa.s * sb.s))"
    joins = ""
    if mult:
        weight += " * sqrt((pa.mult * pb.mult)::DOUBLE)"
        joins = "JOIN pr pa ON pa.pid = src JOIN pr pb ON pb.pid = dst"
    return f"""sig AS (SELECT i, max(d) AS s FROM nn GROUP BY i),
    ed AS (SELECT src, dst, d, greatest({weight}, {floor}::DOUBLE) AS w FROM (
        SELECT least(i, j) AS src, greatest(i, j) AS dst, max(d) AS d, count(*) AS votes FROM nn GROUP BY 1, 2) p
        JOIN sig sa ON sa.i = src JOIN sig sb ON sb.i = dst {joins} {votes})"""


def lf(x: str) -> str:
    return f"lgamma((({x}) + 1)::DOUBLE)"


def _hyper(k: str) -> str:
    return (f"exp({lf('a+b')} - {lf(k)} - {lf(f'a+b-{k}')} + {lf('c+d')} - {lf(f'a+c-{k}')} - {lf(f'd-a+{k}')}"
            f" - {lf('a+b+c+d')} + {lf('a+c')} + {lf('b+d')})")


def fisher_greater() -> str:
    return f"list_sum(list_transform(range(a, least(a+b, a+c) + 1), lambda k: {_hyper('k')}))"


def fisher_two_sided() -> str:
    return (f"least(1.0, list_sum(list_transform(range(greatest(0, a-d), least(a+b, a+c) + 1), lambda k: "
            f"CASE WHEN {_hyper('k')} <= {_hyper('a')} * (1 + 1e-7) THEN {_hyper('k')} ELSE 0 END)))")


def binomial(x: str, n: str, p: str) -> str:
    pmf = (f"exp({lf(n)} - {lf('k')} - {lf(f'({n})-k')} + k * ln({p}) + (({n}) - k) * ln(1 - ({p})))")
    return (f"CASE WHEN ({x})::DOUBLE / ({n}) >= ({p}) THEN list_sum(list_transform(range(({x})::BIGINT, ({n})::BIGINT + 1), lambda k: {pmf})) "
            f"ELSE list_sum(list_transform(range(0, ({x})::BIGINT + 1), lambda k: {pmf})) END")


def two_sided_normal(z: str) -> str:
    """2 P(Z > |z|) from the positive series of the normal integral."""
    t = f"abs({z})"
    term = f"exp((2*k+1)*ln({t}) - {t}*{t}/2 - (k*ln(2.0) + lgamma(k + 1.5) - lgamma(1.5)))"
    return (f"CASE WHEN {t} < 1e-300 THEN 1.0 ELSE 1.0 - 2.0 / sqrt(2 * pi()) * "
            f"list_sum(list_transform(range(0, 200), lambda k: {term})) END")


def bh(p: str, part: str = "") -> str:
    over = f"PARTITION BY {part} " if part else ""
    return (f"least(1.0, min(raw) OVER ({over}ORDER BY {p} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


def raw_bh(p: str, part: str = "") -> str:
    over = f"PARTITION BY {part} " if part else ""
    return f"{p} * count({p}) OVER ({over.strip()}) / row_number() OVER ({over}ORDER BY {p})"
