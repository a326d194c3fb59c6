"""Print the physical plans of headline operators over *stored* tables.

The corpus is written once as versioned parquet tables (partitioned by project) in a
scratch folder, read back, and each operator's formatted plan is printed: look for
PushedFilters / ReadSchema on the scans, partial HashAggregate before exchanges, and
WindowGroupLimit before the shuffle of every top-k.

usage: python scripts/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codeatlas.operators import docs as D  # noqa: E402
from codeatlas.operators import card, extract_python, extract_ts, graph, nodes, render, search  # noqa: E402
from codeatlas.operators.search_index import SearchIndex  # noqa: E402
from codeatlas.session import get_session  # noqa: E402
from codeatlas.sources import corpus, tables  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    base = tempfile.mkdtemp(prefix="codeatlas-plans-", dir="/tmp")
    tables.write_table(corpus.edges(spark, sf), base, "edges")
    tables.write_table(corpus.elements(spark, sf), base, "elements")
    tables.write_table(corpus.files(spark, sf), base, "files")
    tables.write_table(corpus.docs(spark, sf), base, "docs")
    edges = tables.read_table(spark, base, "edges")
    elements = tables.read_table(spark, base, "elements")
    files = tables.read_table(spark, base, "files")
    docs = tables.read_table(spark, base, "docs")
    index = SearchIndex.build(docs)
    shows = {
        "deps('red_widget_17') on stored edges": graph.deps(edges, "red_widget_17").select("src_path", "from_element", "type"),
        "deps in one project (partition pruning)": graph.deps(edges.where("project = 'repo1'"), "red_widget_17"),
        "hotspots(k=10)": graph.hotspots(edges, 10),
        "element_edges(limit=50)": graph.element_edges(edges, elements, 50),
        "doc_coverage": D.doc_coverage(elements, docs),
        "doc_search('thhe redd anat'), one pass over the texts": search.doc_search(docs, "thhe redd anat"),
        "doc scores from the stored index": search.doc_hits(docs, "thhe redd anat", index=index),
        "ts_elements": extract_ts.ts_elements(corpus.ts_src_files(spark, sf)),
        "ts_edges": extract_ts.ts_edges(corpus.ts_src_files(spark, sf)),
        "py calls with scope": extract_python.python_calls(extract_python.lines_of(corpus.src_files(spark, sf))),
        "card": card.explain(files, elements, edges, docs, elements.select("project", "name")),
        "dot_edges": render.render_dot(edges),
        "arch_browse('widget')": nodes.arch_browse(files, elements, "widget"),
    }
    print("# Plans of headline operators over stored tables\n\nPrinted by `scripts/show_plans.py`: initial plans (adaptive execution on), long lines cut.")
    for title, df in shows.items():
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain()
        lines = [re.sub(r"Location: \S+ ?\([^)]*\)\[[^\]]*\]|, \[plan_id=\d+\]|#\d+L?", "", x) for x in text.getvalue().strip().splitlines()]
        print(f"\n## {title}\n\n```")
        print("\n".join(x[:200] for x in lines))
        print("```")
    spark.stop()


if __name__ == "__main__":
    main()
