"""python -m attestra COMMAND

list                      names of the queries
run NAME SF_DIR [OUT]     run a query, and show or store its rows
status SF_DIR             rows of the tables
seed FOLDER               write the small corpus of dossiers
process FOLDER OUT        from its files to findings; prints open and blocking ones
review OUT FILE           take decisions (JSON lines) on readings and findings of the last run
report OUT FOLDER         CSV, JSON and HTML of the last run
reindex OUT               embed the chunks of the last run that are new or changed
reset OUT                 remove all runs under OUT
"""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from .plans import catalogue
    from .session import session, ship

    if args[:1] == ["list"]:
        print("\n".join(catalogue.QUERIES))
        return 0
    if args[:1] == ["run"] and len(args) >= 3 and args[1] in catalogue.QUERIES:
        out = catalogue.QUERIES[args[1]](session(), args[2])
        out.write.parquet(args[3]) if len(args) > 3 else out.show(50, truncate=False)
        return 0
    if args[:1] == ["status"] and len(args) == 2:
        catalogue.QUERIES["agg09_table_counts"](session(), args[1]).show()
        return 0
    if args[:1] == ["seed"] and len(args) == 2:
        from . import corpus

        print("\n".join(corpus.write(args[1])))
        return 0
    if args[:1] == ["process"] and len(args) == 3:
        from . import process

        process.summary(process.process(ship(session()), args[1], args[2])).show(1000, truncate=False)
        return 0
    if args[:1] == ["review"] and len(args) == 3:
        from . import process

        spark = session()
        wanted = spark.read.schema("dossier_id string, target string, key string, action string, new_value string, reason string, actor string, expected_revision bigint").json(args[2])
        process.review(spark, args[1], wanted).select("dossier_id", "target", "key", "action", "outcome").show(1000, truncate=False)
        return 0
    if args[:1] == ["report"] and len(args) == 3:
        from . import process

        process.report(session(), args[1], args[2])
        return 0
    if args[:1] == ["reindex"] and len(args) == 2:
        from . import process

        print(process.reindex(session(), args[1]), "chunks embedded")
        return 0
    if args[:1] == ["reset"] and len(args) == 2:
        from . import process

        process.reset(session(), args[1])
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
