"""The templates of the registered license scan.

Texts: the files of ``license_texts``, whole; from Debian's
``/usr/share/common-licenses`` (Apache, Artistic, BSD of the Regents, CC0,
GFDL, GPL, LGPL, MPL) and from published packages (0BSD, BSD, BSL, MIT,
Unlicense; without copyright lines); Zlib's was written down from the public
text.  Headers: the notices that the licenses tell authors to attach.  Lines:
common ways to name a license; none was taken from supplied rows.

A line has at most four shingles, so that all must be found (three of four are
under 0.8) and one that differs only in the version is not taken for it.
"""

from __future__ import annotations

from pathlib import Path

from .licenses import TEMPLATES

_GNU = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free "
    "Software Foundation; either version {2} of the License, or (at your option) any later version. This {0} is distributed in the "
    "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {1} for more details.")

HEADERS = {
    "GPL-2.0-notice": _GNU.format("program", "General Public License", "2"),
    "LGPL-2.1-notice": _GNU.format("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0-notice": _GNU.format("library", "Lesser General Public License", "3"),
    "AGPL-3.0-notice": _GNU.format("program", "Affero General Public License", "3"),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "CC0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
}

#: Names that follow "licensed under", "released under" and "distributed under".
_NAMES = {
    "MIT": ["the MIT License", "the terms of the MIT license", "the MIT/X11 license"],
    "ISC-line": ["the ISC License"],
    "Apache-2.0": ["the Apache License 2.0", "Apache License, Version 2.0", "the Apache 2.0 license", "Apache-2.0"],
    "BSD-line": ["the BSD License", "a BSD-style license"],
    "BSD-2-Clause-line": ["the BSD 2-Clause License", "the 2-Clause BSD License", "BSD-2-Clause", "the Simplified BSD License"],
    "BSD-3-Clause-line": ["the BSD 3-Clause License", "the 3-Clause BSD License", "BSD-3-Clause", "the New BSD License"],
    "MPL-1.1-line": ["MPL 1.1", "the MPL 1.1", "the MPL, version 1.1"],
    "MPL-2.0-line": ["MPL 2.0", "the MPL 2.0", "the MPL, version 2.0"],
    "GPL-2.0-line": ["GPL 2.0", "the GPL v2", "the GNU GPL v2", "the GPL version 2", "the GNU GPL version 2", "the GPL-2.0"],
    "GPL-3.0": ["GPL 3.0", "the GPL v3", "the GNU GPL v3", "the GPL version 3", "the GNU GPL version 3", "the GPL-3.0"],
    "LGPL-2.1-line": ["LGPL 2.1", "the LGPL 2.1", "the LGPL v2.1", "the GNU LGPL v2.1", "the LGPL version 2.1"],
    "LGPL-3.0-line": ["LGPL 3.0", "the LGPL v3", "the GNU LGPL v3", "the LGPL version 3", "the GNU LGPL version 3"],
    "AGPL-3.0-line": ["AGPL 3.0", "the AGPL v3", "the GNU AGPL v3", "the AGPL version 3", "the GNU AGPL version 3"],
    "Unlicense-line": ["the terms of the Unlicense"],
    "CC0-1.0-line": ["CC0 1.0", "the CC0 1.0", "Creative Commons Zero 1.0", "CC0 1.0 Universal"],
    "EPL-2.0-line": ["EPL 2.0", "the EPL 2.0", "the Eclipse Public License 2.0"],
    "BSL-1.0-line": ["the Boost Software License 1.0"],
    "Zlib-line": ["the zlib License"],
    **{f"CC-{x}-{v}" + ("" if (x, v) == ("BY-NC", "4.0") else "-line"): [f"CC {x} {v}", f"a CC {x} {v}", f"the CC {x} {v}"]
       for x in ("BY", "BY-SA", "BY-NC", "BY-ND") for v in ("2.0", "3.0", "4.0")},
    **{f"CC-{x}-{v}-line": [f"CC {x} {v}"] for x in ("BY-NC-SA", "BY-NC-ND") for v in ("2.0", "3.0", "4.0")},
}

LINES = {
    **{name: [f"{verb} under {x}" for x in names for verb in ("Licensed", "Released", "Distributed")] for name, names in _NAMES.items()},
}
for _name, _more in {
    "GPL-2.0-line": ["GNU General Public License version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU General Public License v3.0"],
    "LGPL-2.1-line": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0-line": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0-line": ["GNU Affero General Public License version 3", "GNU Affero General Public License v3.0"],
    "MPL-1.1-line": ["Mozilla Public License, Version 1.1", "Mozilla Public License, v. 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0-line": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "Unlicense-line": ["This is free and unencumbered software"],
    "CC0-1.0-line": ["CC0 1.0 Universal Public Domain Dedication"],
}.items():
    LINES[_name] += _more
for _words, _code in {"Attribution": "BY", "Attribution-ShareAlike": "BY-SA", "Attribution-NonCommercial": "BY-NC", "Attribution-NoDerivatives": "BY-ND"}.items():
    for _v in ("2.0", "3.0", "4.0"):
        LINES[f"CC-{_code}-{_v}" + ("" if (_code, _v) == ("BY-NC", "4.0") else "-line")].append(f"Creative Commons {_words} {_v}")


def public_templates() -> dict[str, list[str]]:
    """The wordings of each license name: ``TEMPLATES``, headers, lines and whole texts."""
    found = {name: [text] for name, text in TEMPLATES.items()}
    for name, text in HEADERS.items():
        found.setdefault(name, []).append(text)
    for name, lines in LINES.items():
        found.setdefault(name, []).extend(lines)
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        found.setdefault(f"{path.stem}-text", []).append(path.read_text(encoding="utf-8"))
    return found
