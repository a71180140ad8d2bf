"""Write the physical plan trees of the headline queries to PLANS.md.

Each query is executed once (noop sink) so AQE's final plan is shown.
Usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import io
import os
import sys
import tempfile
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = ["keyword_search", "items_with_reviews", "filter_min_year", "knn_descriptions", "knn_approx", "semantic_search",
            "prefilter_hits", "fuzzy_title_match", "filter_batch_counts", "upsert_items", "table_upsert", "page_slice", "encode_text_batch"]
KEEP = ("Exchange", "Join", "Broadcast", "WindowGroupLimit", "MapInArrow", "MapInPandas", "HashAggregate",
        "ObjectHashAggregate", "TakeOrderedAndProject", "Scan parquet", "Window", "ExistingRDD")


def main() -> None:
    from trove.session import get_spark
    from trove.registry import QUERIES
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("trove-plans", master="local[8]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="trove-plans-")})
    out = ["# Physical plans of the headline queries", "",
           f"Final adaptive plans at `{sf}` (operators that shape the work; full plans via `explain('formatted')`).",
           "A scan of a scratch table (search hits, candidates, changes, stored keys) reads an intermediate that",
           "was written once to the shared folder; the branches that read it do not repeat the work before it.", ""]
    for name in HEADLINE:
        df = QUERIES[name](spark, sf)         # as the operators return it, before its result is stored
        df.write.format("noop").mode("overwrite").save()
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n")[0]
        lines = [ln for ln in tree.splitlines() if any(k in ln for k in KEEP)]
        pushed = [ln.strip() for ln in text.splitlines() if ln.startswith("PushedFilters") and ln.strip() != "PushedFilters: []"]
        out += [f"## {name}", "", "```"] + lines + ["```", ""]
        if pushed:
            out += ["Pushed filters: " + "; ".join(sorted(set(p.replace("PushedFilters: ", "") for p in pushed))), ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
