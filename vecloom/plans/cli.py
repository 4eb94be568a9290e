"""python -m vecloom.plans.cli: the command line over folders of Parquet tables."""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path

from ..operators import encoder
from ..sources import descriptor, graph
from ..sources.store import Store
from . import maintain, options, search


def models_dir() -> Path:
    return Path.home() / ".vecloom" / "models"


def main(args: list[str] | None = None) -> int:
    try:
        o = options.parse(sys.argv[1:] if args is None else args)
    except options.UsageError as e:
        print(e, file=sys.stderr)
        return 1
    if o.mode == "version":
        print(encoder.VERSION)
        return 0
    if o.mode == "capabilities":
        print(json.dumps(encoder.capabilities()))
        return 0
    folder = models_dir() / o.model_id
    if not folder.is_dir():
        print(f"no model {o.model_id} in {models_dir()}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("vecloom").getOrCreate()
    d, store, g = descriptor.load(folder), Store(spark, o.embed_db or f"{o.db}/embed"), graph.read(spark, o.db)
    try:
        if o.mode == "rebuild":
            print(json.dumps(maintain.rebuild(store, g, o.model_id)))
        elif o.mode == "reindex":
            stop = Path(o.cancel_sentinel) if o.cancel_sentinel else None
            done = maintain.reindex(store, g, o.model_id, d, str(folder), o.phase, o.shard, o.rows, o.parallel or 1, lambda: bool(stop and stop.exists()), o.rebuild_on_cancel)
            print(json.dumps({"state": done.state, "pending": done.pending, "report": done.report}))
        else:
            s = search.Searcher(store, g, o.model_id, d, str(folder), os.environ.get("VECLOOM_MEMO_TRACE"))
            for line in sys.stdin:
                ask = json.loads(line)
                print(json.dumps(s.answer(ask["query_text"], int(ask["k"]), ask.get("space", "code"))), flush=True)
    except Exception as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
