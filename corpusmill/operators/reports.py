"""Reports: small results of the operators as Markdown, CSV and HTML."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..schemas import CRITERIA
from ..sources.store import Store
from . import geometry, ranking
from .judging import by_judge


def number(x: float | None, digits: int = 3) -> str:
    """with its sign, or n/a."""
    return "n/a" if x is None or x != x else f"{x:+.{digits}f}"


def markdown_table(headers: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """G15."""
    clean = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"| {' | '.join(map(clean, headers))} |", f"|{'---|' * len(headers)}", *[f"| {' | '.join(map(clean, r))} |" for r in rows]])


def _table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a table; reports show at most ``limit`` rows and say so."""
    rows = df.limit(limit + 1).collect()
    text = markdown_table(df.columns, [[number(x) if isinstance(x, float) else "n/a" if x is None else x for x in r] for r in rows[:limit]])
    return text + (f"\n\nThe first {limit} rows." if len(rows) > limit else "")


def gold_report(pairs: DataFrame, judge: str, method: str = "chunk") -> str:
    """Validation against gold, by criterion and by tier."""
    tiers = stats.tier_counts(pairs, ["criterion", "tier"], F.col("gold_pos")).orderBy("criterion", "tier")
    return f"# Gold validation\n\nJudge {judge}, method {method}.\n\n{_table(ranking.gold_validation(pairs).orderBy('criterion'))}\n\n## Tiers\n\n{_table(tiers)}\n"


def comparison_report(old: DataFrame, new: DataFrame, report: DataFrame) -> str:
    """Verdicts before and after, graded values, and pooled correlations."""
    parts = ["# Comparison of verdicts", _table(ranking.compared(old, new).orderBy("criterion", "side"))]
    if "graded" in new.columns:
        parts += ["## Levels", _table(stats.graded_histogram(new, ["criterion"], "graded").orderBy("criterion", "level")), "## Spread", _table(stats.graded_spread(new, ["criterion"], "graded").orderBy("criterion"))]
    parts += ["## Correlation with scores", _table(ranking.pooled_rho(report).orderBy("criterion", "method"))]
    return "\n\n".join(parts) + "\n"


def sweep_report(grid: DataFrame) -> str:
    """Correlations over the grid and the best cells."""
    return f"# Levers\n\n{_table(grid.orderBy('criterion', 'cell'))}\n\n## Best\n\n{_table(ranking.best_cells(grid).orderBy('criterion'))}\n"


def main_report(store: Store, run: str = "baseline", judge: str | None = None, min_n: int = 10) -> tuple[str, DataFrame]:
    """The report of a run, and its scores and verdicts as one wide row a paper."""
    scores = store.read("embedding_scores", run=run)
    verdicts = by_judge(store.read("verdicts"), judge)
    report = ranking.report_rows(scores, verdicts)
    parts = [f"# Report of run {run}"]
    for c in CRITERIA:
        top = report.where(F.col("criterion") == c).select("code_number", "pdf_path", "method", "e", "verdict").orderBy(F.desc("e"), "pdf_path")
        parts += [f"## {c}", _table(top, 50)]
    topics = store.read("chunk_topics", run=run)
    from .topics import dominant

    parts += ["## Correlation of scores and verdicts", _table(ranking.pooled_rho(report).orderBy("criterion", "method"))]
    parts += ["## By topic", _table(ranking.topic_rho(report, dominant(topics, ["pdf_path"]), min_n))]
    parts += ["## Poles", _table(store.read("pole_separation", run=run).select("pole", "pair", "cosine").orderBy("pole", "pair"))]
    parts += ["## Controls", _table(store.read("control_scores", run=run).select("name", "criterion", "e").orderBy("name", "criterion"))]
    wide = report.groupBy("code_number", "pdf_path").agg(
        *[F.max(F.when((F.col("criterion") == c) & (F.col("method") == m), F.col("e"))).alias(f"{c}_{m}") for c in CRITERIA for m in ("full", "abstract", "chunk")],
        *[F.max(F.when(F.col("criterion") == c, F.col("verdict"))).alias(f"{c}_verdict") for c in CRITERIA],
    )
    return "\n\n".join(parts) + "\n", wide


def recompute_run(store: Store, is_self: Column, k: int, strength: float, run_ts: Column, run: str = "baseline") -> None:
    """Scores of a run anew: self-references out, geometry fitted, scores and controls upserted without their model."""
    vectors = store.read("doc_vectors", run=run)
    dropped = vectors.where(is_self).select("run", "pdf_path").distinct()
    store.delete("embedding_scores", dropped, ["run", "pdf_path"])
    kept = vectors.where(~is_self)
    fitted = geometry.fit(kept, store.read("pole_vectors", run=run), k, strength)
    stamp = {"run": F.lit(run), "run_ts": run_ts}
    store.upsert("embedding_scores", geometry.recompute(kept, fitted).withColumns(stamp), ["e", "run_ts"])
    controls = store.read("control_vectors", run=run)
    if not controls.isEmpty():
        store.upsert("control_scores", geometry.score_controls(controls, fitted).withColumns(stamp))
    widths = store.spark.createDataFrame([("within", c, w) for c, w in fitted.within.items()], "pole string, pair string, cosine double")
    store.upsert("pole_separation", widths.withColumns(stamp))
    settings = store.spark.createDataFrame([(run, "whiten_k", str(k)), (run, "shared_strength", str(strength))], "run string, k string, v string")
    store.upsert("run_meta", settings)


def ranking_page(records: DataFrame, title: str, limit: int | None = 5000) -> str:
    """A page that filters and sorts the ranking in the browser; ranks and values come with it.

    A page holds the first ``limit`` papers by code and path and says how many there are; None has all of them. The
    ranking of a whole corpus is ``ranking.ranked``, as a table.
    """
    names = ["code_number", "code_name", "paper_name", "pdf_path", "topics", *[f"{s}_{c}" for s in "eo" for c in CRITERIA]]
    have = [n for n in names if n in records.columns]
    rows = records.select(*have).orderBy(*[n for n in ("code_number", "pdf_path") if n in have])
    shown = [r.asDict() for r in (rows if limit is None else rows.limit(limit)).collect()]
    total = len(shown) if limit is None or len(shown) < limit else records.count()
    note = "" if total == len(shown) else f"<p>The first {len(shown)} of {total} papers by code and path.</p>"
    data = json.dumps(shown).replace("</", "<\\/")
    return f"""<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{note}
<input id="q" placeholder="filter"> <select id="s"><option value="e">scores<option value="o">verdicts</select>
<select id="m"><option>mean<option>median<option>min</select><table id="t"></table>
<script>
const rows = {data}, criteria = {json.dumps(list(CRITERIA))};
const pick = (v, m) => {{ v = v.filter(x => x !== null && x !== undefined).sort((a, b) => a - b); const n = v.length;
  if (!n) return null; if (m === "min") return v[0]; if (m === "mean") return v.reduce((a, b) => a + b) / n;
  return (v[Math.floor((n - 1) / 2)] + v[Math.floor(n / 2)]) / 2; }};
const show = () => {{
  const q = document.getElementById("q").value.toLowerCase(), s = document.getElementById("s").value, m = document.getElementById("m").value;
  const found = rows.filter(r => JSON.stringify(r).toLowerCase().includes(q)).map(r => [pick(criteria.map(c => r[s + "_" + c]), m), r]);
  found.sort((a, b) => (b[0] ?? -Infinity) - (a[0] ?? -Infinity));
  const table = document.getElementById("t"); table.textContent = "";
  found.forEach(([v, r], i) => {{ const tr = table.insertRow();
    [i + 1, v === null ? "n/a" : v.toFixed(3), r.code_number, r.code_name, r.paper_name || r.pdf_path, (r.topics || []).join(", ")].forEach(x => tr.insertCell().textContent = x ?? ""); }});
}};
for (const id of ["q", "s", "m"]) document.getElementById(id).addEventListener("input", show);
show();
</script>"""


