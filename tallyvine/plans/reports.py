"""Accuracy reports: result frames written by Spark, text from their few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyvine.operators import evaluate as E

# Frames with a row per document; they are left to their files, all others are aggregates or short lists.
ONE_ROW_A_DOCUMENT = ("samples",)


def header_report(fields: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    outcomes = E.header_outcomes(fields, truth)
    scored = E.scores(E.outcome_counts(outcomes, "field"))
    return {
        "fields": scored,
        "macro": E.macro_f1(scored, E.HEADER_GATE),
        "samples": E.sample_summary(outcomes),
        "failures": E.first_header_failures(outcomes),
    }


def item_report(predicted: DataFrame, gold: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    outcomes = E.item_outcomes(E.align_items(predicted, gold))
    counts = E.item_counts(predicted, gold, docs)
    scored = E.scores(E.outcome_counts(outcomes, "field"))
    return {
        "fields": scored,
        "macro": E.macro_f1(scored, E.ITEM_GATE),
        "counts": E.item_count_accuracy(counts),
        "failures": E.failing_items(outcomes, counts),
    }


def rules_report(findings: DataFrame, summary: DataFrame) -> dict[str, DataFrame]:
    return {
        "rules": E.rule_rates(findings),
        "clean": E.clean_rate(summary),
        "failures": E.first_rule_failures(findings),
    }


def write_report(frames: dict[str, DataFrame], path: str) -> None:
    """Each frame as JSON below ``path``."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")


def markdown(title: str, frames: dict[str, DataFrame]) -> str:
    """Markdown tables of a report's aggregates and lists."""
    out = [f"# {title}", ""]
    for name, frame in frames.items():
        out += [f"## {name}", ""]
        if name in ONE_ROW_A_DOCUMENT:
            out += [f"See the `{name}` files.", ""]
            continue
        out.append("| " + " | ".join(frame.columns) + " |")
        out.append("|" + "---|" * len(frame.columns))
        for row in frame.collect():
            cells = ["" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row]
            out.append("| " + " | ".join(cells) + " |")
        out.append("")
    return "\n".join(out) + "\n"
