"""python -m leafpress convert | init | config show|validate | profile list|show|use|set. Exit codes: 0, 1 (run), 2 (usage)."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from leafpress.plans import options as O

CONFIG = "leafpress.json"
#: How a page of an input becomes an image, by kind of input ("pdf", "text"); without an entry Poppler does it.
RASTERS: dict = {}
FLAGS = {
    "output": "-o", "output_dir": "--output-dir", "ocr_mode": "--ocr", "ocr_engine": "--ocr-engine", "ocr_layout": "--ocr-layout", "zh_script": "--zh-script",
    "split_preset": "--split-preset", "split_every": "--split-every", "workers": "--workers",
}
SWITCHES = {"force": "--force", "classical_zh_postprocess": "--ocr-classical-zh-postprocess", "key_content_fallback": "--ocr-key-content-fallback"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafpress")
    sub = p.add_subparsers(dest="command", required=True)

    def with_options(x: argparse.ArgumentParser) -> None:
        for key, flag in FLAGS.items():
            x.add_argument(flag, dest=key)
        for key, flag in SWITCHES.items():
            x.add_argument(flag, dest=key, action="store_true", default=None)
        x.add_argument("--ocr-fallback", dest="ocr_fallback", action="store_true")
        x.add_argument("--profile")
        x.add_argument("--path", default=CONFIG)

    convert = sub.add_parser("convert", help="convert PDF files to Markdown")
    convert.add_argument("inputs", nargs="+")
    convert.add_argument("--max-pages", type=int)
    convert.add_argument("--ocr-profile", default="none")
    with_options(convert)
    init = sub.add_parser("init", help="write a config file")
    init.add_argument("--force", action="store_true")
    init.add_argument("--path", default=CONFIG)
    config = sub.add_parser("config").add_subparsers(dest="action", required=True)
    with_options(config.add_parser("show"))
    config.add_parser("validate").add_argument("--path", default=CONFIG)
    profile = sub.add_parser("profile").add_subparsers(dest="action", required=True)
    for name, args in (("list", ()), ("show", ("name",)), ("use", ("name",)), ("set", ("name", "key", "value"))):
        x = profile.add_parser(name)
        for a in args:
            x.add_argument(a, nargs="?" if name == "show" else None)
        x.add_argument("--path", default=CONFIG)
    return p


def effective(args: argparse.Namespace) -> tuple[dict, dict]:
    given = {k: O.checked(k, getattr(args, k)) for k in O.DEFAULTS if getattr(args, k, None) is not None}
    if args.ocr_fallback:
        given.setdefault("ocr_mode", "auto")
    return O.layered(given, O.env_values(), O.profile_values(O.read_config(args.path), args.profile or O.env_profile()))


def convert(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from leafpress.plans import engine
    from leafpress.sources import ocr_engines as E
    from leafpress.sources import pdf, sinks

    values, _ = effective(args)
    chosen = O.ConvertOptions(ocr_profile=args.ocr_profile, max_pages=args.max_pages, **{k: v for k, v in values.items() if k in O.ConvertOptions.__dataclass_fields__})
    if values["output"] and len(args.inputs) > 1:
        raise O.OptionError("--output names one file; use --output-dir for several inputs.")
    begin = time.monotonic()
    spark = SparkSession.builder.appName("leafpress").getOrCreate()
    files = spark.createDataFrame([(Path(x).resolve().as_uri(),) for x in args.inputs], "path string")
    plain = all(x.lower().endswith(".txt") for x in args.inputs)
    adapter = pdf.text_adapter if plain else pdf.default_adapter
    ocr = None
    if chosen.ocr_mode != "off":
        raster = RASTERS.get("text" if plain else "pdf", E.poppler)
        if (why := E.missing(chosen.ocr_engine, raster)) is None:
            ocr = E.ocr_pass(pdf.contents(spark, files), chosen.ocr_engine, chosen.ocr_layout, raster, chosen.ocr_mode == "strict")
        elif chosen.ocr_mode == "strict":
            raise RuntimeError(why)
        else:
            print(f"{why} The native text stays.", file=sys.stderr)
    pages = pdf.pages(spark, files, adapter, args.max_pages, values["workers"]).cache()
    errors = pages.filter("error IS NOT NULL").select("doc_id", "error").collect()
    for r in errors:
        print(f"{r.doc_id}: {r.error}", file=sys.stderr)
    done = engine.to_markdown(engine.converted(pages.filter("error IS NULL"), chosen, ocr=ocr), chosen)
    folder, name = values["output_dir"], None
    if values["output"]:
        folder, name = str(Path(values["output"]).parent), Path(values["output"]).name
    elif folder is None and len(args.inputs) == 1:
        folder, name = sinks.default_output(args.inputs[0])
    folder = folder or "."
    out = sinks.write_markdown(sinks.named(done, chosen.every is not None, name), folder, chosen.force)
    print("\n".join(out))
    print(sinks.performance_report("native" if ocr is None else "ocr", folder, pages.count(), {"total": time.monotonic() - begin}), file=sys.stderr)
    return int(bool(errors))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "convert":
            return convert(args)
        if args.command == "init":
            if Path(args.path).exists() and not args.force:
                raise FileExistsError(f"{args.path} exists (use --force)")
            O.write_config(args.path, {"profile": "default", "profiles": {"default": {k: v for k, v in O.DEFAULTS.items() if v is not None}}})
        elif args.command == "config" and args.action == "show":
            values, source = effective(args)
            print(json.dumps({k: {"value": v, "source": source[k]} for k, v in values.items()}, indent=2, sort_keys=True))
        elif args.command == "config":
            config = O.read_config(args.path)
            for name in config.get("profiles", {"": {}}):
                O.profile_values(config, name)
            print("ok")
        else:
            config = O.read_config(args.path)
            profiles = config.setdefault("profiles", {})
            if args.action == "list":
                print("\n".join(sorted(profiles)))
                return 0
            name = args.name or config.get("profile")
            if args.action != "set" and name not in profiles:
                raise O.OptionError(f"Unknown profile: {name}")
            if args.action == "show":
                print(json.dumps(profiles[name], indent=2, sort_keys=True))
                return 0
            if args.action == "use":
                config["profile"] = name
            else:
                profiles.setdefault(name, {})[args.key] = O.checked(args.key, args.value)
            O.write_config(args.path, config)
    except O.OptionError as e:
        print(e, file=sys.stderr)
        return 2
    except (OSError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
