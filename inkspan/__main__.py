"""Command line: analyze, profile, compare, revise, providers, validate, version.

Exit codes: 0, 1 where the input is refused or a revision rejected, 2 for bad arguments or settings.
"""

from __future__ import annotations

import argparse
import difflib
import json
import os
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkspan")
    p.add_argument("--config")
    p.add_argument("--verbose", action="store_const", const=True)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="the analysis record of each file, as JSON lines")
    a.add_argument("paths", nargs="+")
    a.add_argument("--pretty", action="store_true")
    a.add_argument("--top-k", type=int, default=20)
    a.add_argument("--character-ngrams", type=int, metavar="N")
    a.add_argument("--language", default="en")
    b = sub.add_parser("profile", help="a profile document of all files")
    b.add_argument("paths", nargs="+")
    b.add_argument("--context", default="general")
    b.add_argument("--top-k", type=int, default=30)
    b.add_argument("--out")
    c = sub.add_parser("compare", help="each draft against a profile document or the samples that one is made of")
    c.add_argument("--drafts", nargs="+", required=True)
    against = c.add_mutually_exclusive_group(required=True)
    against.add_argument("--samples", nargs="+")
    against.add_argument("--profile")
    c.add_argument("--weights", type=json.loads)
    c.add_argument("--draft-context")
    c.add_argument("--out")
    c.add_argument("--pretty", action="store_true")
    r = sub.add_parser("revise", help="a draft revised towards the samples' profile by a provider")
    r.add_argument("--draft", required=True)
    r.add_argument("--samples", nargs="+", required=True)
    r.add_argument("--request", default="")
    r.add_argument("--mode")
    r.add_argument("--attempts", type=int, default=1)
    r.add_argument("--provider")
    r.add_argument("--mock-text", help="the mock provider's answer; without it the draft comes back")
    r.add_argument("--out")
    r.add_argument("--report")
    r.add_argument("--show-diff", action="store_true")
    v = sub.add_parser("validate", help="check a profile document")
    v.add_argument("path")
    sub.add_parser("providers")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from inkspan import __version__
    from inkspan.sources import config

    try:
        settings = config.load_config(args.config, os.environ, {"verbose": args.verbose, "mode": getattr(args, "mode", None), "provider": getattr(args, "provider", None)})
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    try:
        if args.command == "version":
            print(__version__)
        elif args.command == "providers":
            from inkspan.functions.providers import list_providers

            print("\n".join(list_providers()))
        elif args.command == "validate":
            return _validate(args.path)
        else:
            return _with_spark(args, settings)
    except (OSError, ValueError, TypeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def _validate(path: str) -> int:
    from inkspan.sources import files

    with open(path, encoding="utf-8") as f:
        profile = json.load(f)
    errors = files.validate_profile(profile)
    status, notes = files.check_compatibility(profile)
    print("\n".join(errors or [f"valid, {status}", *notes]))
    return 1 if errors or status == "unsupported" else 0


def _put(text: str, path: str | None) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


def _with_spark(args, settings) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from inkspan.functions import providers
    from inkspan.operators import compare as cp
    from inkspan.operators import profile as pf
    from inkspan.operators import record as rc
    from inkspan.operators import report as rp
    from inkspan.operators import revise as rv
    from inkspan.sources import config, files
    from inkspan.sources.tables import materialise

    spark = SparkSession.builder.getOrCreate()
    log = config.logger(settings["verbose"])
    one = F.lit("author").alias("author")

    def samples_of(paths: list[str]):
        return files.read_texts(spark, paths).select(one, "sample_index", "text")

    if args.command == "analyze":
        for r in rc.analysis_records(files.read_texts(spark, args.paths), "text", args.top_k, args.character_ngrams is not None, args.character_ngrams or 3, args.language).toLocalIterator():
            print(files.to_json(r.asDict(True), args.pretty))
    elif args.command == "profile":
        made = pf.build_profiles(samples_of(args.paths), context=args.context, top_k=args.top_k).collect()  # one author
        if not made:
            raise ValueError("no sample has words")
        profile = files.profile_document(made[0].asDict(True))
        if args.out:
            files.save_profile(profile, args.out)
            log.info("profile written")
        else:
            print(files.to_json(profile, True))
    elif args.command == "compare":
        cp.check_weights(args.weights)
        drafts = files.read_texts(spark, args.drafts).select("path", one, "text")
        if args.samples:
            found = rp.compare(drafts, samples_of(args.samples), ["path"], weights=args.weights, draft_context=args.draft_context)
        else:
            profile = files.load_profile(args.profile)
            numbers, wanted, metadata = files.profile_tables(spark, profile)
            mine = materialise(pf.sample_table(drafts), "drafts")
            rows = materialise(cp.rows_against(mine, numbers, wanted, ["path"], "author"), "rows")
            found = rp.reports(rows, mine, metadata, ["path"], "author", args.weights, profile["metadata"]["context"], args.draft_context)
        _put("\n".join(files.to_json(r.asDict(True), args.pretty) for r in found.toLocalIterator()), args.out)
    else:
        provider = providers.get_provider(settings["provider"])
        if args.mock_text is not None:
            provider = providers.fixed(args.mock_text)
        with open(args.draft, encoding="utf-8") as f:
            draft = f.read()
        drafts = spark.createDataFrame([(args.draft, "author", draft, args.request)], "key string, author string, draft string, user_request string")
        r = rv.revise_drafts(drafts, samples_of(args.samples), provider, args.attempts, settings["mode"]).first()
        if r is None:
            raise ValueError("no sample has words")
        if not r["passed"]:
            print(f"rejected: {'; '.join(r['failures'])}", file=sys.stderr)
            return 1
        _put(r["revised"], args.out)
        if args.report:
            _put(files.to_json({k: v for k, v in r.asDict(True).items() if k != "revised"}, True), args.report)
        if args.show_diff:
            print("\n".join(difflib.unified_diff(draft.splitlines(), r["revised"].splitlines(), "draft", "revised", lineterm="")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
