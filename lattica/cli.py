"""``python -m lattica.cli compress|decompress|bench|version ...``: containers from files, and the report on them."""

from __future__ import annotations

import argparse
import sys

from lattica.functions.scalars import parse_size, video_rows
from lattica.plans import advisor, sizing
from lattica.sources import container


def chosen(a: argparse.Namespace) -> advisor.Options:
    """The preset, and then only what was given explicitly."""
    changes = {k: getattr(a, k) for k in ("width", "segment_size", "no_prep", "no_quick_reject") if getattr(a, k) is not None}
    if a.video:
        changes["width"], changes["frame_rows"] = video_rows(a.video)
        changes.setdefault("segment_size", sizing.segment_size(0, changes["width"], changes["frame_rows"]))
    return advisor.options(a.preset, **changes)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattica")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("compress", "bench"):
        c = sub.add_parser(name)
        c.add_argument("files", nargs="+")
        c.add_argument("--preset", choices=sorted(advisor.PRESETS), default="default")
        c.add_argument("--width", type=int)
        c.add_argument("--segment", dest="segment_size", type=parse_size)
        c.add_argument("--big-segment", type=parse_size, default=0)
        c.add_argument("--memory", type=parse_size, default=1 << 30)
        c.add_argument("--video")
        c.add_argument("--no-prep", action="store_true", default=None)
        c.add_argument("--no-reject", dest="no_quick_reject", action="store_true", default=None)
        c.add_argument("--head", type=parse_size, default=0)
    d = sub.add_parser("decompress")
    d.add_argument("files", nargs=2)
    d.add_argument("--max-size", type=parse_size, default=0)
    d.add_argument("--memory", type=parse_size, default=0)
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 1 if a file is damaged or missing; wrong arguments end with 2."""
    a = parser().parse_args(argv)
    try:
        if a.command == "version":
            print(f"lattica, container version {container.VERSION}")
        elif a.command == "decompress":
            with open(a.files[0], "rb") as f:
                data = container.unpack(f.read(), a.max_size, a.memory)
            container.write_whole(a.files[1], data, a.files[0])
        elif a.command == "compress":
            if len(a.files) != 2:
                raise ValueError("compress takes an input and an output")
            with open(a.files[0], "rb") as f:
                data = f.read(a.head or -1)
            made = container.pack(data, chosen(a), sizing.big_segment_size(a.memory, a.big_segment))
            container.write_whole(a.files[1], made, a.files[0])
        else:
            print("file\tsize\tflate\tprep\tchosen\tout\tratio")
            for path in a.files:
                with open(path, "rb") as f:
                    data = f.read(a.head or -1)
                mode, body, sizes = advisor.encode(data, chosen(a))
                print(path, len(data), sizes.get("flate", "-"), sizes.get("prep", "-"), mode, len(body), f"{len(body) / max(len(data), 1):.4f}", sep="\t")
    except (OSError, ValueError) as e:
        print(f"lattica: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
