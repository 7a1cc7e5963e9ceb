"""python -m sparkloom COMMAND ...: a thin command line over api.Engine."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .api import Engine, as_json
from .sources.store import NAME, discover

COMMANDS = {
    "index": ("index", ["repo"]), "search": ("search", ["query"]), "deps": ("dependencies", ["entity"]), "impact": ("impact", ["entity"]),
    "trace": ("trace", ["start", "goal"]), "cycles": ("cycles", []), "smells": ("smells", []), "deadcode": ("dead_code", []), "layers": ("layers", []),
    "owner": ("owners", ["entity"]), "context": ("context", ["query"]), "brief": ("brief", []), "files": ("list_files", []), "status": ("status", []),
}


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="sparkloom")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("args", nargs="*")
    p.add_argument("--db")
    p.add_argument("--force", action="store_true")
    p.add_argument("--no-embed", action="store_true")
    o = p.parse_args(argv)
    method, wanted = COMMANDS[o.command]
    if len(o.args) != len(wanted):
        p.error(f"{o.command} takes {', '.join(wanted) or 'no arguments'}")
    repo = o.args[0] if o.command == "index" else "."
    db = o.db or str(discover(repo) or f"{repo}/{NAME}")
    spark = SparkSession.builder.appName("sparkloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, db, repo, read_only=o.command != "index")
    if o.command == "index":
        out = engine.index(o.force, not o.no_embed)
    else:
        out = getattr(engine, method)(*([[o.args[0]]] if o.command == "context" else o.args))
    for x in out if isinstance(out, tuple) else (out,):
        print(as_json(x) if isinstance(x, DataFrame) else json.dumps(x))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
