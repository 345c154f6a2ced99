"""SQL of the solver queries: matrix algebra over lists, by other algorithms than the library's.

A matrix is a table of one row whose column ``m`` is a list of rows. Linear systems are solved by Gauss-Jordan elimination in a
recursive query, Sylvester equations by Smith's doubling, where the library uses LAPACK and eigenvectors.
"""

from __future__ import annotations


def number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


class Algebra:
    """Collects the named tables of a query; every method adds one and returns its name."""

    def __init__(self, head: str) -> None:
        self.parts = [head.strip().removeprefix("WITH ")]

    def table(self, sql: str) -> str:
        name = f"m{len(self.parts)}"
        self.parts.append(f"{name} AS MATERIALIZED ({sql})")
        return name

    def matrix(self, rows: str, value: str = "v") -> str:
        """From a table or subquery of rows (i, j, value), all cells given."""
        return self.table(f"SELECT list(r ORDER BY i) AS m FROM (SELECT i, list({value} ORDER BY j) AS r FROM {rows} GROUP BY i)")

    def each(self, a: str, value: str) -> str:
        """Every cell by an expression of its value x and its place i, j (from 1)."""
        return self.table(f"SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: {value})) AS m FROM {a}")

    def t(self, a: str) -> str:
        return self.table(f"SELECT list_transform(range(1, len(m[1]) + 1), lambda j: list_transform(m, lambda r: r[j])) AS m FROM {a}")

    def mul(self, a: str, b: str, *more: str) -> str:
        out = self.table(f"SELECT list_transform(a.m, lambda r: list_transform(b.m, lambda c: list_dot_product(r, c))) AS m FROM {a} a, {self.t(b)} b")
        return self.mul(out, *more) if more else out

    def plus(self, a: str, b: str, scale: float = 1.0) -> str:
        return self.table(f"SELECT list_transform(a.m, lambda r, i: list_transform(r, lambda x, j: x + {number(scale)} * b.m[i][j])) AS m FROM {a} a, {b} b")

    def scaled(self, a: str, scale: float) -> str:
        return self.each(a, f"x * {number(scale)}")

    def ridged(self, a: str, reg: float, but_last: bool = False) -> str:
        on = "i = j AND i < len(m)" if but_last else "i = j"
        return self.table(f"SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x + CASE WHEN {on} THEN {number(reg)} ELSE CAST(0 AS DOUBLE) END)) AS m FROM {a}")

    def eye(self, like: str) -> str:
        return self.each(like, "CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")

    def beside(self, *blocks: str) -> str:
        out = blocks[0]
        for b in blocks[1:]:
            out = self.table(f"SELECT list_transform(a.m, lambda r, i: list_concat(r, b.m[i])) AS m FROM {out} a, {b} b")
        return out

    def solve(self, a: str, b: str) -> str:
        """a^-1 b for a positive definite: elimination needs no pivoting."""
        both = self.beside(a, b)
        steps = f"m{len(self.parts)}"
        clear = "list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k])"
        self.parts.append(
            f"{steps}(k, m) AS (SELECT CAST(1 AS BIGINT), m FROM {both} UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k]) ELSE {clear} END) FROM {steps} WHERE k <= len(m))"
        )
        return self.table(f"SELECT list_transform(m, lambda r: r[len(m) + 1:]) AS m FROM {steps} WHERE k = len(m) + 1")

    def right_solve(self, a: str, b: str) -> str:
        """a b^-1 for b positive definite."""
        return self.t(self.solve(b, self.t(a)))

    def sylvester(self, Q: str, M: str, L: str, R: str, C: str, shift: float = 1.0, doublings: int = 10) -> str:
        """W with Q^-1 M W + W L R^-1 = C: the sum over k of U^k Y V^k with the Cayley transforms U and V of both factors."""
        left, right = self.plus(M, Q, shift), self.plus(L, R, shift)
        U = self.solve(left, self.plus(M, Q, -shift))
        V = self.right_solve(self.plus(L, R, -shift), right)
        Y = self.scaled(self.right_solve(self.mul(self.solve(left, self.mul(Q, C)), R), right), 2 * shift)
        for _ in range(doublings):
            Y = self.plus(Y, self.mul(U, Y, V))
            U, V = self.mul(U, U), self.mul(V, V)
        return Y

    def total(self, *pairs: tuple[str, str, float]) -> str:
        """A matrix of one cell: the sum of all products of two matrices' cells, scaled."""
        terms = " + ".join(f"{number(s)} * (SELECT list_sum(list_transform(a.m, lambda r, i: list_dot_product(r, b.m[i]))) FROM {a} a, {b} b)" for a, b, s in pairs)
        return self.table(f"SELECT [[{terms}]] AS m")

    def rows(self, a: str, names: tuple[str, str] = ("i", "j"), value: str = "w", places: int = 6) -> str:
        """The whole query: the cells of a matrix, places counted from 0."""
        i, j = names
        return self.query(
            f"SELECT {i}, CAST(generate_subscripts(r, 1) - 1 AS BIGINT) AS {j}, round(unnest(r), {places}) + 0.0 AS {value} FROM (SELECT CAST(generate_subscripts(m, 1) - 1 AS BIGINT) AS {i}, unnest(m) AS r FROM {a})"
        )

    def query(self, final: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(self.parts) + "\n" + final

    def marginal(self, S: str, keep: float, bias: bool = False) -> str:
        """Expected second moments of corrupted features."""
        k = number(keep)
        if not bias:
            return self.each(S, f"x * CASE WHEN i = j THEN {k} ELSE {k} * {k} END")
        q = "CASE WHEN {0} < len(m) THEN " + k + " ELSE CAST(1 AS DOUBLE) END"
        return self.table(f"SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x * {q.format('i')} * CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE {q.format('j')} END)) AS m FROM {S}")

    def mapping(self, S: str, noise: float, reg: float, bias: bool, outputs: int | None = None) -> str:
        """W of a denoising autoencoder, of the first ``outputs`` features or all."""
        k = number(1 - noise)
        if bias:
            P = self.table(f"SELECT list_transform(m[1:len(m) - 1], lambda r: list_transform(r, lambda x, j: x * CASE WHEN j < len(r) THEN {k} ELSE CAST(1 AS DOUBLE) END)) AS m FROM {S}")
        else:
            P = self.scaled(S, 1 - noise)
        if outputs is not None:
            P = self.table(f"SELECT m[1:{outputs}] AS m FROM {P}")
        return self.right_solve(P, self.ridged(self.marginal(S, 1 - noise, bias), reg, bias))

    def domain_mapping(self, S: str, total: str, xd: str, noise: float, alpha: float, eta: float, reg: float) -> str:
        """W of the domain-regularized autoencoder that pushes to the target; total and xd are columns."""
        c = self.solve(self.ridged(S, alpha), xd)
        ct = self.t(c)
        push = self.mul(total, ct)
        right = self.plus(self.scaled(S, 1 - noise), push, eta * (1 - noise))
        right = self.right_solve(right, self.ridged(self.scaled(self.mul(c, ct), eta), 1.0))
        return self.t(self.solve(self.ridged(self.marginal(S, 1 - noise), reg), right))


VECTORS = """
WITH e AS (SELECT vec_id, vec_id % 3 AS dom, vec_id % 3 < 2 AS src, vec_id % 3 < 2 OR vec_id % 10 = 0 AS known, label,
    generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
g AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS s, sum(a.x * b.x) FILTER (a.known) AS k, sum(a.x * b.x) FILTER (a.dom = 0) AS s0, sum(a.x * b.x) FILTER (a.dom = 1) AS s1
    FROM e a JOIN e b USING (vec_id) GROUP BY ALL),
c AS (SELECT DISTINCT label AS cls FROM embeddings)"""
GAP = {
    False: """SELECT j, 0 AS k, avg(x) FILTER (dom = 0) - avg(x) FILTER (dom = 1) AS v FROM e GROUP BY j UNION ALL SELECT j, 1, avg(x) FILTER (dom = 0) - avg(x) FILTER (dom = 2) FROM e GROUP BY j
    UNION ALL SELECT j, 2, avg(x) FILTER (dom = 1) - avg(x) FILTER (dom = 2) FROM e GROUP BY j""",
    True: """SELECT j, 3 * cls + k AS k, coalesce(CASE k WHEN 0 THEN a0 - a1 WHEN 1 THEN a0 - a2 ELSE a1 - a2 END, 0) AS v FROM (SELECT unnest([0, 1, 2]) AS k),
    (SELECT j, cls, avg(x) FILTER (dom = 0) AS a0, avg(x) FILTER (dom = 1) AS a1, avg(x) FILTER (dom = 2) AS a2 FROM e JOIN c ON label = cls WHERE known GROUP BY ALL)""",
}
#: The settings of the queries, as published: noise, and the weights of the terms; the guard on diagonals.
KEEP, MDA_REG, TD_REG, TC_REG, TINY, ROUNDS, TOLERANCE = 0.9, 1e-3, 1.0, 1.0, 1e-10, 5, 1e-5


def regularized(method: str, iterate: bool) -> str:
    """W of a method of the regularized family over ``embeddings``; all weights of terms are 1."""
    x = Algebra(VECTORS)
    Sa, S = x.matrix("g", "s"), x.matrix("g", "k")
    Pa, Qa, Q = x.scaled(Sa, KEEP), x.ridged(x.marginal(Sa, KEEP), TINY), x.ridged(x.marginal(S, KEEP), TINY)
    reg, one = x.ridged(Qa, MDA_REG), x.eye(Sa)
    if "M" in method and method != "MDA":
        v = x.table(GAP["CM" in method])
        gap = x.matrix(f"(SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM {v} a JOIN {v} b USING (k) GROUP BY ALL)")
        gap = x.ridged(x.marginal(gap, KEEP), TINY)
    else:
        gap = x.scaled(one, 0.0)
    if method == "MDA":
        return x.rows(x.solve(reg, Pa))
    if method in ("TM", "TCM"):
        return x.rows(x.solve(x.plus(reg, gap), Pa))
    XYD = x.matrix("(SELECT e.j AS i, d.d AS j, sum(CASE WHEN dom = d.d THEN x ELSE -x END) AS v FROM e, (SELECT unnest([0, 1, 2]) AS d) d GROUP BY ALL)")
    Pd = x.matrix("(SELECT e.j AS i, d.d AS j, sum(CASE WHEN d.d = 2 THEN x ELSE -x END) AS v FROM e, (SELECT unnest([0, 1, 2]) AS d) d GROUP BY ALL)")
    ZD = x.solve(x.ridged(Sa, TD_REG), XYD)
    R = x.plus(one, x.mul(ZD, x.t(ZD)))
    push = x.plus(Pa, x.mul(Pd, x.t(ZD)), KEEP)
    if method == "TD":
        return x.rows(x.solve(Qa, x.right_solve(push, R)))
    if method in ("TDr", "TDM", "TDCM"):
        return x.rows(x.sylvester(Qa, x.plus(x.scaled(one, MDA_REG), gap), R, one, x.solve(Qa, push)))

    domain = method.startswith("TD")
    M, right, base = (Qa, R, push) if domain else (x.plus(reg, gap), one, Pa)
    XY = x.matrix("(SELECT e.j AS i, cls AS j, sum(CASE WHEN label = cls THEN x ELSE -x END) AS v FROM e, c WHERE known GROUP BY ALL)")
    ridge_like, from_map = method.endswith("CW"), method.endswith("WC")

    def step(ZC: str, xy: str) -> str:
        C = x.solve(Q, x.right_solve(x.plus(base, x.mul(xy, x.t(ZC)), KEEP), right))
        return x.sylvester(Q, M, x.mul(ZC, x.t(ZC)), right, C)

    if not iterate and not from_map:
        zs = []
        for d in (0, 1):
            own, xy = x.matrix("g", f"s{d}"), x.matrix(f"(SELECT e.j AS i, cls AS j, sum(CASE WHEN label = cls THEN x ELSE -x END) AS v FROM e, c WHERE dom = {d} GROUP BY ALL)")
            zs.append(x.solve(x.ridged(own if ridge_like else x.ridged(x.marginal(own, KEEP), TINY), TC_REG), xy))
        return x.rows(step(x.beside(*zs), x.beside(XY, XY)))

    def classifier(W: str) -> str:
        Wt = x.t(W)
        return x.solve(x.ridged(x.mul(Wt, Q, W), TC_REG), x.scaled(x.mul(Wt, XY), KEEP))

    ZC = classifier(x.solve(reg, Pa)) if from_map else x.solve(x.ridged(S if ridge_like else Q, TC_REG), XY)
    tried = []
    for _ in range(ROUNDS):
        W = step(ZC, XY)
        ZC = classifier(W)
        Z = x.mul(W, ZC)
        terms = [(W, x.mul(Qa, W), 1.0), (x.t(Pa), W, -2.0), (ZC, ZC, TC_REG), (Z, x.mul(Q, Z), 1.0), (XY, Z, -2 * KEEP)]
        if domain:
            D = x.mul(W, ZD)
            terms += [(D, x.mul(Qa, D), 1.0), (Pd, D, -2 * KEEP)]
        else:
            terms += [(W, W, MDA_REG), (W, x.mul(gap, W), 1.0)]
        tried.append((W, x.total(*terms)))
    settled = [f"abs({a}.m[1][1] - {b}.m[1][1]) < {number(TOLERANCE)} * abs({b}.m[1][1])" for (_, a), (_, b) in zip(tried, tried[1:])]
    case = " ".join(f"WHEN {s} THEN {w}.m" for s, (w, _) in zip(settled, tried[1:]))
    last = x.table(f"SELECT CASE {case} ELSE {tried[-1][0]}.m END AS m FROM {', '.join(dict.fromkeys(n for pair in tried[1:] for n in pair))}, {tried[0][1]}")
    return x.rows(last)
