"""Evaluation results as text."""

from __future__ import annotations

from typing import Any


def ranking_report(results: dict[str, Any]) -> str:
    """The variants of ``Engine.compare`` in a table, recall at 1 by category, and what the best one misses."""
    out = [f"{results['questions']} questions, by file", f"{'variant':<16}{'R@1':>8}{'R@3':>8}{'R@5':>8}{'MRR':>8}{'ms':>8}"]
    for r in results["overall"]:
        out.append(f"{r.variant:<16}{r.recall_at_1:>8.1%}{r.recall_at_3:>8.1%}{r.recall_at_5:>8.1%}{r.mrr:>8.3f}{1000 * results['seconds'][r.variant]:>8.0f}")
    variants = [r.variant for r in results["overall"]]
    out += [f"best MRR: {results['best']}", "", f"{'R@1 by category':<20}" + "".join(f"{v:>16}" for v in variants)]
    for r in results["by_category"]:
        out.append(f"{r.category or '-':<20}" + "".join(f"{r[v]:>16.0%}" if r[v] is not None else f"{'-':>16}" for v in variants))
    out += ["", f"{results['best']}: not first ({len(results['misses'])})"]
    out += [f"  {m.query_id}: {'rank ' + str(m.correct) if m.correct else 'not found'}; got {', '.join(m.files or []) or 'nothing'}" for m in results["misses"]]
    return "\n".join(out)


def refusal_report(rows: list[dict[str, Any]]) -> str:
    """Rates of ``Engine.hallucination_run``, by category, and the answers that claim something."""
    total, refused = len(rows), sum(r["refused"] for r in rows)
    rate = lambda k, n: f"{k}/{n}" + (f" ({k / n:.1%})" if n else "")
    out = [f"{total} questions about what is not there", f"declined: {rate(refused, total)}", f"claimed: {rate(total - refused, total)}"]
    for c in sorted({r["category"] or "-" for r in rows}):
        own = [r for r in rows if (r["category"] or "-") == c]
        out.append(f"  {c:<20} {rate(sum(r['refused'] for r in own), len(own))}")
    out += [f"  [{r['id']}] {r['question']} -> {r['answer'][:200]}" for r in rows if not r["refused"]]
    return "\n".join(out)
