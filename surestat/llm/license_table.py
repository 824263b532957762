"""Builds license_digests_v1.csv, the canonical digests of entire licence texts, from a folder of texts named by SPDX id.

    python -m surestat.llm.license_table FOLDER

Copyright lines are dropped line by line before a text is made canonical, so a digest depends on whether a line happens to
begin with that word. Each text is therefore taken as it is, with a paragraph a line, and wrapped at WIDTHS. Titles and closing
instructions, which licence matching treats as optional, are taken both ways.
"""

from __future__ import annotations

import csv
import hashlib
import re
import sys
import textwrap
from collections.abc import Iterator
from pathlib import Path

from .licenses import DIGESTS, EQUIVALENT

WIDTHS = range(60, 121)
#: Titles that stand before a text, or don't.
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "Zlib": ["zlib License", "The zlib License"],
}
#: Where closing instructions begin; the text before is the licence's terms.
CLOSINGS = re.compile(r"\n[ \t]*(APPENDIX: How to apply the Apache License|(?:Appendix: )?How to Apply These Terms to Your New|ADDENDUM: How to use this License|Exhibit A - Source Code Form)", re.IGNORECASE)
#: Notices for source files, from their first to their last words in the closing instructions.
HEADERS = {
    "GPL-2.0": ("GPL-2.0-or-later", r"This program is free software.*?51 Franklin Street, Fifth Floor, Boston, MA 02110-1301[, ]+USA\."),
    "GPL-3.0": ("GPL-3.0-or-later", r"This program is free software: you can.*?<https?://www\.gnu\.org/licenses/>\."),
    "LGPL-2.1": ("LGPL-2.1-or-later", r"This library is free software.*?51 Franklin Street, Fifth Floor, Boston, MA\s+02110-1301\s+USA"),
    "MPL-2.0": ("MPL-2.0", r"This Source Code Form is subject to.*?http://mozilla\.org/MPL/2\.0/\."),
}


def canonical(text: str) -> str:
    """As licenses.canonical_lines(), joined by blanks."""
    out = []
    for line in text.lower().split("\n"):
        if re.match(r"\W*(copyright|\(c\)|©)", line):
            continue
        words = re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", line).strip(" ").split(" ")
        spelt = f" {'  '.join(EQUIVALENT.get(w, w) for w in words)} "
        for a, b in EQUIVALENT.items():
            if " " in a:
                spelt = spelt.replace(f" {a.replace(' ', '  ')} ", f" {b} ")
        out.append(" ".join(spelt.split()))
    return " ".join(x for x in out if x)


def layouts(text: str) -> Iterator[str]:
    yield text
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    yield "\n".join(paragraphs)
    for width in WIDTHS:
        yield "\n".join("\n".join(textwrap.wrap(p, width, break_on_hyphens=False)) for p in paragraphs)


def versions(name: str, text: str) -> Iterator[tuple[str, str]]:
    """(license, text) of the whole text, its terms alone, and its header."""
    if name in TITLES:
        first, _, rest = text.partition("\n")
        body = rest if canonical(first) in map(canonical, TITLES[name]) else text
        bodies = [body]
        if name.startswith("BSD-"):
            bodies += [f"All rights reserved.\n\n{body}"]
            for old, new in ((r"(?m)^\s*\d\. ", "* "), (r"COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER AND CONTRIBUTORS"), (r"the copyright holder nor the names of its", "the copyright holders nor the names of its")):
                bodies += [re.sub(old, new, x) for x in bodies]
            bodies += [x.replace("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS") for x in bodies]
        for body in bodies:
            yield name, body
            for title in TITLES[name]:
                yield name, f"{title}\n\n{body}"
        return
    yield name, text
    if cut := CLOSINGS.search(text):
        yield name, text[: cut.start()]
        yield name, re.sub(r"\n\s*END OF TERMS AND CONDITIONS\s*$", "\n", text[: cut.start()])
    if name in HEADERS:
        license, words = HEADERS[name]
        yield license, re.search(words, text, re.DOTALL)[0]


def main(folder: str) -> None:
    found: dict[str, str] = {}
    for path in sorted(Path(folder).glob("*.txt")):
        for name, text in versions(path.stem, path.read_text(encoding="utf-8")):
            for layout in layouts(text):
                digest = hashlib.sha256(canonical(layout).encode()).hexdigest()
                found[digest] = min(name, found.get(digest, name))
    with DIGESTS.open("w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["license", "digest"])
        out.writerows(sorted((name, digest) for digest, name in found.items()))


if __name__ == "__main__":
    main(sys.argv[1])
