"""Small helpers to compose the oracle SQL text from named CTE fragments."""

from __future__ import annotations


class CteBook:
    """Named SQL fragments with dependencies; ``render`` emits a WITH-query."""

    def __init__(self) -> None:
        self.sql: dict[str, str] = {}
        self.deps: dict[str, tuple[str, ...]] = {}

    def add(self, name: str, sql: str, *deps: str) -> None:
        self.sql[name] = sql.strip()
        self.deps[name] = deps

    def _order(self, needs) -> list[str]:
        seen: list[str] = []

        def visit(n: str) -> None:
            if n in seen:
                return
            for d in self.deps[n]:
                visit(d)
            seen.append(n)

        for n in needs:
            visit(n)
        return seen

    def render(self, body: str, *needs: str) -> str:
        names = self._order(needs)
        body = body.strip()
        if not names:
            return body
        ctes = ",\n".join(f"{n} AS (\n{self.sql[n]}\n)" for n in names)
        if body[:4].upper() == "WITH":
            return f"WITH {ctes},\n{body[4:].strip()}"
        return f"WITH {ctes}\n{body}"


def fin(body: str, doubles=(), ints=(), src: str = "q") -> str:
    """Wrap a SELECT: round doubles to 6 places (and fold -0.0), cast integers to BIGINT."""
    reps = [f"(round(CAST({c} AS DOUBLE), 6) + 0.0) AS {c}" for c in doubles]
    reps += [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
    if not reps:
        return f"SELECT * FROM ({body}) {src}"
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM ({body}) {src}"


def count_if_to_filter(sql: str) -> str:
    """Rewrite count_if(c) as count(*) FILTER (WHERE c): 0, not NULL, when c is never true."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(f"count(*) FILTER (WHERE {count_if_to_filter(sql[j + len(key):k - 1])})")
        i = k
