"""Reports from small collected frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Rows that a report holds at most; a longer frame is no report.
MOST = 10_000


def collected(df: DataFrame, order: Sequence[str]) -> list[dict]:
    rows = df.orderBy(*order).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a report of more than {MOST} rows")
    return [r.asDict() for r in rows]


def percent(x: float | None, signed: bool = False) -> str:
    return "" if x is None else f"{'+' if signed and x >= 0 else ''}{x * 100:.1f}%"


def shown(value, column: str) -> str:
    if value is None:
        return ""
    return percent(value, column.endswith(("_diff", "delta"))) if isinstance(value, float) else str(value)


def _line(cells: Sequence[str]) -> str:
    return "| " + " | ".join(cells) + " |"


def _bold(rows: list[dict], columns: Sequence[str], bold_most: Sequence[str]) -> list[str]:
    """A line a row; in the columns named the largest value is bold."""
    most = {c: max((r[c] for r in rows if r[c] is not None), default=None) for c in bold_most}
    best = lambda r, c: c in most and r[c] is not None and r[c] == most[c]
    return [_line([f"**{shown(r[c], c)}**" if best(r, c) else shown(r[c], c) for c in columns]) for r in rows]


def markdown(rows: list[dict], columns: Sequence[str], bold_most: Sequence[str] = ()) -> str:
    """A table; in the columns named the largest value is bold."""
    return "\n".join([_line(columns), _line(["---"] * len(columns)), *_bold(rows, columns, bold_most)]) + "\n"


def with_references(rows: list[dict], columns: Sequence[str], references: Sequence[str], label: str, drop: float | None) -> str:
    """A result table whose reference models stand below the others, under a
    label; the global drop, which leaves them out, stands between, or at the end without any."""
    own, others = ([r for r in rows if (r["model"] in references) == there] for there in (False, True))
    lines = [_line(columns), _line(["---"] * len(columns)), *_bold(own, columns, ())]
    scope = " (main rows only)" if others else ""
    lines += ["", f"Global Average Drop{scope}: {percent(drop, True)}"]
    if others:
        lines += ["", _line([label] + [""] * (len(columns) - 1)), *_bold(others, columns, ())]
    return "\n".join(lines) + "\n"


def grouped(rows: list[dict], columns: Sequence[str], by: str, bold_most: Sequence[str], last: str = "Average") -> str:
    """A table in groups of rows of one value, in the order in which it comes
    first, the group named last at the end after a line; the largest value of each group is bold."""
    groups: dict[str, list[dict]] = {}
    for r in rows:
        groups.setdefault(r[by], []).append(r)
    lines = [_line(columns), _line(["---"] * len(columns))]
    for name in sorted(groups, key=lambda g: g == last):
        if name == last and len(groups) > 1:
            lines.append(_line(["---"] * len(columns)))
        lines += _bold(groups[name], columns, bold_most)
    return "\n".join(lines) + "\n"


def latex(rows: list[dict], columns: Sequence[str]) -> str:
    safe = lambda s: s.replace("%", r"\%").replace("_", r"\_").replace("&", r"\&")
    return "".join(" & ".join(safe(shown(r[c], c)) for c in columns) + r" \\" + "\n" for r in rows)


def csv_lines(rows: list[dict], columns: Sequence[str]) -> str:
    import csv
    import io

    out = io.StringIO()
    writer = csv.DictWriter(out, columns, lineterminator="\n")
    writer.writeheader()
    writer.writerows({c: "" if r[c] is None else r[c] for c in columns} for r in rows)
    return out.getvalue()
