"""python -m folia.cli info|text|pages FILE."""

from __future__ import annotations

import sys

from folia import __version__
from folia.api import open_pdf
from folia.errors import FoliaError

USAGE = """folia info  FILE          page count and metadata
folia text  FILE [PAGE]   text of all pages, or of one
folia pages FILE          number, size and rotation of each page
folia --version"""


def main(args: list[str]) -> int:
    command, rest = (args[0], args[1:]) if args else ("help", [])
    if command in ("--version", "-v"):
        print(__version__)
        return 0
    if command in ("help", "--help", "-h"):
        print(USAGE)
        return 0
    if command not in ("info", "text", "pages") or not rest:
        print(f"unknown command: {command}\n{USAGE}" if rest else "error: a FILE is needed", file=sys.stderr)
        return 1
    try:
        with open_pdf(rest[0]) as doc:
            if command == "info":
                print(f"file:  {rest[0]}\npages: {doc.page_count}")
                for key, value in doc.metadata.items():
                    if value:
                        print(f"{key + ':':<13} {value}")
            elif command == "text" and len(rest) > 1:
                print(doc[int(rest[1])].get_text())
            elif command == "text":
                for page in doc:
                    print(f"===== page {page.number} =====\n{page.get_text()}")
            else:
                for page in doc:
                    print(f"page {page.number:<3}  {str(page.rect):<22}  rotation={page.rotation}")
    except (FoliaError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
