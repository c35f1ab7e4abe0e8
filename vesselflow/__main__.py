"""Command line: ``python -m vesselflow {ingest,refresh,study,stream} ...`` (spark-submit friendly)."""

from __future__ import annotations

import argparse
import json


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="vesselflow")
    sub = ap.add_subparsers(dest="cmd", required=True)

    ing = sub.add_parser("ingest", help="raw CSV folder -> modelled pings (parquet, year/month partitions)")
    ing.add_argument("--raw", required=True)
    ing.add_argument("--polygons", required=True)
    ing.add_argument("--ports")
    ing.add_argument("--out", required=True)
    ing.add_argument("--model", choices=["band", "mixture"], default="band")

    st = sub.add_parser("study", help="every result table of the analysis")
    st.add_argument("--pings", required=True)
    st.add_argument("--polygons", required=True)
    st.add_argument("--permits", required=True)
    st.add_argument("--landings", required=True)
    st.add_argument("--out", required=True)
    st.add_argument("--calendar", choices=["reference", "fixture"], default="reference")
    st.add_argument("--no-bayesian", action="store_true")
    st.add_argument("--strict", action="store_true", help="a series of unexpected length is an error")
    st.add_argument("--publish", action="store_true", help="write a new version of --out and switch to it when it is whole")

    st.add_argument("--states", help="folder of refresh: hours and areas start from its states instead of the pings")

    sm = sub.add_parser("stream", help="incremental ingest of newly landed raw files")
    sm.add_argument("--landing", required=True)
    sm.add_argument("--polygons", required=True)
    sm.add_argument("--out", required=True)
    sm.add_argument("--continuous", action="store_true")
    sm.add_argument("--checkpoint", help="stream offsets (default: a folder in --out, the same after every restart)")

    rf = sub.add_parser("refresh", help="partial states of newly landed and changed files, for study --states")
    rf.add_argument("--pings", required=True)
    rf.add_argument("--polygons", required=True)
    rf.add_argument("--out", required=True)
    rf.add_argument("--calendar", choices=["reference", "fixture"], default="reference")

    ap.add_argument("--master")
    a = ap.parse_args(argv)

    from vesselflow.session import build_session
    spark = build_session(a.master)
    from vesselflow.plans import study as S

    if a.cmd == "ingest":
        print(S.ingest_raw(spark, a.raw, a.polygons, a.out, ports=a.ports, model=a.model))
    elif a.cmd == "study":
        from vesselflow.constants import FIXTURE_STUDY, REFERENCE_STUDY
        cal = REFERENCE_STUDY if a.calendar == "reference" else FIXTURE_STUDY
        options = {"bayesian": not a.no_bayesian, "strict": a.strict, "states": a.states}
        paths = S.StudyPaths(a.pings, a.polygons, a.permits, a.landings)
        run = S.publish_study if a.publish else S.run_study
        print(json.dumps(run(spark, paths, a.out, cal, **options), indent=1))
    elif a.cmd == "refresh":
        from vesselflow.constants import FIXTURE_STUDY, REFERENCE_STUDY
        cal = REFERENCE_STUDY if a.calendar == "reference" else FIXTURE_STUDY
        print(json.dumps(S.refresh_states(spark, a.pings, a.polygons, a.out, cal)))
    else:
        from vesselflow.streaming.ingest import start_ingest
        mpa = S.layers_from(spark.read.parquet(a.polygons))["mpa"]
        q = start_ingest(spark, a.landing, a.out, mpa, checkpoint=a.checkpoint, available_now=not a.continuous)
        q.awaitTermination()


if __name__ == "__main__":
    main()
