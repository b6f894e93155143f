"""License templates: full texts, notices, and families that are built by rule.

The wordings are fixed values, those of the licenses themselves.  Markup is
explained in ``licenses``.
"""

from __future__ import annotations

_GIVEN = "<<alt;licensed|released|distributed|available|published|shared|provided>> under <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> <<beginOptional>>terms of the<<endOptional>>"

#: Label -> templates, as text.
TEXTS: dict[str, list[str]] = {
    "mit": [
        "<<alt;released|licensed|distributed|available|published|provided>> under the <<beginOptional>>terms of the<<endOptional>> MIT license",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;max=12>> (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall
        be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "mit-0": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;max=12>> (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
        THE SOFTWARE IS PROVIDED "AS IS" """,
    ],
    "apache-2.0": [
        """<<alt;licensed|released|distributed|available|published|provided>> under the <<beginOptional>>terms of the<<endOptional>> Apache
        License, <<beginOptional>>Version<<endOptional>> 2.0 <<beginOptional>>(the "License"); you may not use this file except in compliance
        with the License<<endOptional>>""",
    ],
    "isc": [
        """Permission to use, copy, modify, <<alt;and/or|and>> distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "0bsd": [
        """Permission to use, copy, modify, <<alt;and/or|and>> distribute this software for any purpose with or without fee is hereby granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        <<var;max=1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
        use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        <<var;max=1>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        <<var;max=1>> This notice may not be removed or altered from any source distribution.""",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
        by any means.""",
    ],
    "bsl-1.0": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
        and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
        f"{_GIVEN} Boost Software License, <<beginOptional>>Version<<endOptional>> 1.0",
    ],
    "wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        f"{_GIVEN} Mozilla Public License <<beginOptional>><<alt;version|v>><<endOptional>> 2.0",
    ],
    "epl-1.0": [f"{_GIVEN} Eclipse Public License <<beginOptional>><<alt;version|v>><<endOptional>> 1.0"],
    "epl-2.0": [
        "made available under the terms of the Eclipse Public License 2.0",
        f"{_GIVEN} Eclipse Public License <<beginOptional>><<alt;version|v>><<endOptional>> 2.0",
    ],
    "artistic-2.0": [f"{_GIVEN} Artistic License <<beginOptional>>version<<endOptional>> 2.0"],
    "cc0-1.0": [
        f"{_GIVEN} <<alt;CC0|CC0 1.0|Creative Commons Zero|CC0 1.0 Universal>>",
        "has waived all copyright and related or neighboring rights to",
        "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ],
}

_BSD_OPEN = """Redistribution and use in source and binary forms, with or without modification, are permitted
<<beginOptional>>(subject to the limitations in the disclaimer below)<<endOptional>> provided that the following conditions are met:
<<var;max=1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<var;max=1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """<<var;max=1>> <<alt;Neither the name of|Neither the names of>> <<var;max=14>> <<alt;nor the names of its contributors|nor the names of contributors|contributors>> may be
used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_CLOSE = """THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
TEXTS["bsd-2-clause"] = [f"{_BSD_OPEN} {_BSD_CLOSE}"]
TEXTS["bsd-3-clause"] = [f"{_BSD_OPEN} {_BSD_NAMES} {_BSD_CLOSE}"]
TEXTS["bsd"] = [
    """Redistribution and use in source and binary forms, with or without modification, are permitted
    <<beginOptional>>(subject to the limitations in the disclaimer below)<<endOptional>> provided that the following conditions are met""",
]

#: Families of the GNU project: label, name, versions.
GNU = [("gpl", "General", ("1.0", "2.0", "3.0")), ("lgpl", "Lesser General", ("2.1", "3.0")), ("lgpl", "Library General", ("2.0",)), ("agpl", "Affero General", ("3.0",))]
#: Kinds of Creative Commons licenses, in short and at length.
CREATIVE = {
    "by": "Attribution",
    "by-sa": "Attribution-ShareAlike",
    "by-nc": "Attribution-NonCommercial",
    "by-nd": "Attribution-NoDerivatives",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
CREATIVE_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Identifiers that a tag may name, beside those of the families.
IDENTIFIERS = [
    "MIT", "MIT-0", "Apache-1.1", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "Unlicense", "CC0-1.0", "MPL-1.1", "MPL-2.0",
    "EPL-1.0", "EPL-2.0", "BSL-1.0", "WTFPL", "Artistic-1.0", "Artistic-2.0", "MS-PL", "MS-RL", "PostgreSQL", "Python-2.0", "Ruby", "OFL-1.1",
    "EUPL-1.1", "EUPL-1.2", "CDDL-1.0", "CDDL-1.1", "NCSA", "X11", "curl", "libpng-2.0", "OpenSSL", "PHP-3.01", "W3C", "AFL-3.0", "ECL-2.0",
]


def _numbers(version: str) -> str:
    """Ways to write a version: with and without a last .0, led by version, v or nothing."""
    short = version.removesuffix(".0")
    forms = dict.fromkeys(f"{lead}{v}" for lead in ("version ", "v", "v. ", "") for v in (version, short))
    return f"<<alt;{'|'.join(forms)}>>"


def templates() -> list[tuple[str, str]]:
    """(label, template) of everything above."""
    out = [(label, t) for label, texts in TEXTS.items() for t in texts]
    names = list(IDENTIFIERS)
    for label, name, versions in GNU:
        for v in versions:
            own, later = f"{label}-{v}", f"{label}-{v}-or-later"
            license_ = f"GNU {name} Public License"
            published = f"terms of the {license_} as published by the Free Software Foundation; <<beginOptional>>either<<endOptional>> {_numbers(v)} <<beginOptional>>of the License<<endOptional>>"
            given = f"{_GIVEN} {license_} {_numbers(v)}"
            out += [(own, published), (own, given), (later, f"{published} or (at your option) any later version"), (later, f"{given} or <<beginOptional>>(at your option) any<<endOptional>> later")]
            names += [own.upper(), f"{own.upper()}-only", f"{own.upper()}-or-later"]
    for kind, name in CREATIVE.items():
        for v in CREATIVE_VERSIONS:
            out.append((f"cc-{kind}-{v}", f"{_GIVEN} CC {kind.upper()} {v}"))
            out.append((f"cc-{kind}-{v}", f"{_GIVEN} Creative Commons {name} {v}"))
            names.append(f"CC-{kind.upper()}-{v}")
    out += [(n.lower(), f"SPDX-License-Identifier: {n}") for n in dict.fromkeys(names)]
    return out
