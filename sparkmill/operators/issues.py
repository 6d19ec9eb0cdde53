"""An issue log whose findings are counted, not written down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ISSUE_LOG
from .manifest import conflicting_digests, spread_digests

#: Evidence, risk, decision, and action or limitation of each issue.
NOTES = {
    "DQ-01": ("duplicates", "What was trained on is scored again", "Exclude the supplied splits", "Split again from distinct contents"),
    "DQ-02": ("duplicates", "Scores look better than they are", "Keep each digest in one derived split", "Prove that no digest is in two splits"),
    "DQ-03": ("manifest", "The larger class hides errors in the smaller one", "Keep class ratios and weigh classes", "Weights act on training alone"),
    "DQ-04": ("manifest", "One content teaches two answers", "Review by hand", "The label of the first copy holds until then"),
}


def issue_log(rows: DataFrame, positive: str, owner: str = "unassigned") -> DataFrame:
    """The columns of schema.ISSUE_LOG and n, the number found, of a manifest; one aggregate each, no list of files."""
    crossing = spread_digests(rows).agg(F.count("*").alias("n"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("files"))
    conflicts = conflicting_digests(rows.where("label <> 'unknown'")).agg(F.count("*").alias("n"))
    known = rows.where("label <> 'unknown'").agg(F.count_if(F.col("label") != positive).alias("few"), F.count_if(F.col("label") == positive).alias("many"))
    text = lambda c: F.col(c).cast("string")

    def made(source: DataFrame, issue: str, finding, n) -> DataFrame:
        evidence, risk, decision, action = NOTES[issue]
        values = {"issue_id": F.lit(issue), "finding": finding, "evidence_path": F.lit(evidence), "risk": F.lit(risk), "decision": F.lit(decision), "action_or_limitation": F.lit(action),
                  "status": F.when(n > 0, "Open").otherwise("None found"), "owner": F.lit(owner)}
        return source.select(*(values[c].alias(c) for c in ISSUE_LOG.fieldNames()), n.alias("n"))

    rows = [made(crossing, "DQ-01", F.concat(text("files"), F.lit(" files share their content with another split")), F.col("files")),
            made(crossing, "DQ-02", F.concat(text("n"), F.lit(" exact duplicate groups cross splits")), F.col("n")),
            made(known, "DQ-03", F.concat(text("few"), F.lit(" Normal against "), text("many"), F.lit(" Pothole files")), F.greatest(F.col("many") - F.col("few"), F.lit(0))),
            made(conflicts, "DQ-04", F.concat(text("n"), F.lit(" digests carry more than one label")), F.col("n"))]
    return reduce(DataFrame.unionByName, rows)
