"""Reports as plain text. What is cut here is only shown shorter; the values themselves are whole."""

from __future__ import annotations

# How many rows of each list are shown.
SHOWN = {"alternatives": 5, "direct": 20, "indirect": 15, "reasons": 15, "worst": 8}


def _section(title: str, rows: list[str], kind: str | None = None) -> list[str]:
    """A title and its rows, with a line on what isn't shown; nothing without rows."""
    most = SHOWN.get(kind, len(rows))
    more = [f"  and {len(rows) - most} more"] if len(rows) > most else []
    return ["", title, *("  " + r for r in rows[:most]), *more] if rows else []


def percent(x: float | None) -> str:
    return "-" if x is None else f"{100 * x:.0f} %"


def impact(found: dict) -> str:
    """What `Project.impact` found: other meanings of the name first, then the reach, the risk and who is reached."""
    r = found["report"]
    out = [f"target {r['id']}"]
    out += _section("Other symbols of that name; give a whole id to ask about one", found["alternatives"], "alternatives")
    out += _section("Reach", [f"{r['direct']} direct, {r['indirect']} indirect", f"{r['files']} files, {r['tests']} of it tests"])
    out += _section("Risk", [f"{r['risk']}: {r['risk_reason']}"])
    for reach in ("direct", "indirect"):
        rows = [x for x in found["reached"] if x["reach"] == reach]
        out += _section(reach.title(), [f"{x['qualified_name']}  {x['file_path']}  {x['hop_distance']} steps, {x['path_confidence']:.2f}" for x in rows], reach)
    out += _section("What the target needs", [", ".join(r["critical_dependencies"])] if r["critical_dependencies"] else [])
    out += _section("Not certain", [f"{r['low_confidence_edges']} incoming edges are guesses: calls by name alone may be missing or wrong"] if r["low_confidence_edges"] else [])
    return "\n".join(out)


def bench(report: dict) -> str:
    """What `Project.bench` measured: recall beside precision, times, why commits were left out, and the worst cases."""
    out = [f"{report['cases']} cases", f"recall {percent(report['mean_recall'])}, precision {percent(report['mean_precision'])}, {report['misses']} without a hit"]
    if report["cases"]:
        out.append(f"time to context: median {report['median']:.0f} ms, 95th percentile {report['p95']:.0f} ms")
    out += _section("Commits left out", [f"{n} {reason}" for reason, n in sorted(report["rejected"].items(), key=lambda x: (-x[1], x[0]))])
    out += _section("Worst cases", [f"{w['case_id'][:10]}  {percent(w['recall'])}  {w['hits']} of {w['n_expected']} files in {w['n_selected']} selected" for w in report["worst"]], "worst")
    return "\n".join(out)


def context(found: dict, explain: bool) -> str:
    """The package under a summary: what was taken at which cost, and with `explain` the reasons."""
    m = found["metrics"][0] if found["metrics"] else {"selected": 0, "considered": 0, "files": 0, "spent": 0, "reduction": 0.0}
    out = [f"{found['kind']}: {m['selected']} of {m['considered']} entities in {m['files']} files, {m['spent']} tokens, {percent(m['reduction'])} fewer than the project"]
    if explain:
        out += _section("Why they are in", [f"{round(i['score']):3d}  {i['detail']:9s}  {i['id']}: {'; '.join(found['reasons'].get(i['id']) or [])}" for i in found["items"]], "reasons")
    return "\n".join([*out, "", found["package"]])
