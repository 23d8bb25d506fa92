"""Command line: build an index of text files, and count a pattern file in it.

python -m glyphgrid cs LAMBDA TEXT_PATH INDEX_PATH
python -m glyphgrid lc INDEX_PATH PATTERN_PATH

Every byte of a file counts, a final newline too. TEXT_PATH may be a file, a folder or a pattern of either.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans.text_index import TextIndex
from .sources.texts import text_files


def main(args: list[str]) -> int:
    if len(args) == 4 and args[0] == "cs" and args[1].isdigit():
        spark = SparkSession.builder.appName("glyphgrid").getOrCreate()
        print(f"construct index of {args[2]}")
        index = TextIndex.build(text_files(spark, args[2]).select("doc_id", "text"), int(args[1]))
        print(f"serialize index to {args[3]}")
        index.save(args[3])
        return 0
    if len(args) == 3 and args[0] == "lc":
        spark = SparkSession.builder.appName("glyphgrid").getOrCreate()
        print(f"load index from {args[1]}")
        pattern = text_files(spark, args[2]).selectExpr("CAST(0 AS BIGINT) AS pattern_id", "text AS pattern")
        print(TextIndex.load(spark, args[1]).count(pattern).first()["occ"])
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
