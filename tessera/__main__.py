"""python -m tessera scan PATH --out FOLDER | ask PATH QUESTION | overview PATH | diff PATH [--base REF]"""

from __future__ import annotations

import argparse
import subprocess

from tessera.session import session
from tessera.sources.tree import parse_diff, read_tree
from tessera.tools import Project


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("tessera")
    sub = parser.add_subparsers(dest="do", required=True)
    for name, extra in (("scan", ["--out"]), ("ask", ["question"]), ("overview", []), ("diff", ["--base"])):
        p = sub.add_parser(name)
        p.add_argument("path")
        for e in extra:
            p.add_argument(e, **({"default": None} if e.startswith("--") else {}))
    a = parser.parse_args(args)
    spark = session("tessera")
    spark.sparkContext.setLogLevel("ERROR")
    project = Project(read_tree(spark, a.path))
    if a.do == "scan":
        if a.out:
            project.nodes.write.mode("overwrite").parquet(f"{a.out}/nodes")
            project.edges.write.mode("overwrite").parquet(f"{a.out}/edges")
        project.edges.groupBy("type").count().show()
    elif a.do == "ask":
        project.retrieve(a.question).show(truncate=False)
    elif a.do == "overview":
        project.project_overview().show(truncate=False)
    else:
        text = subprocess.run(["git", "diff", "-M", "--unified=0", "--relative", a.base or "HEAD"], cwd=a.path, capture_output=True, text=True, check=True).stdout
        changed, affected = project.impact(parse_diff(spark.createDataFrame([(1, text)], "id int, text string")))
        changed.show(truncate=False)
        affected.orderBy("depth", "guessed", "id").show(60, truncate=False)


if __name__ == "__main__":
    main()
