"""Wording of public licenses and of their usual notices, as templates: ``[ ... ]`` may be left out, ``{n}`` stands for
at most n words of any kind (holders, years, versions). Case and punctuation do not count."""

from __future__ import annotations

# The licenses' own words.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice [(including the next paragraph)] shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {8} BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: [1] [a] Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. [2] [b] Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_NAMES = """[3] [c] Neither the name of {12} nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY {12} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
{12} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_ISC = """Permission to use, copy, modify, and [/or] distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND {8} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL {8} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at {1} www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at {1} [www.] mozilla.org/MPL/2.0"""
_GNU = """free software [;] you can redistribute it and/or modify it under the terms of the GNU {name} as published by the
Free Software Foundation, {grant} {{4}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details"""
_GRANTS = {
    "only": "[either] version {version} [of the License]",
    "or-later": "either version {version} of the License, or (at your option) any later version",
}
_GNU_VERSIONS = {
    "gpl": ("General Public License", ("2", "3")),
    "lgpl": ("Lesser General Public License", ("2.1", "3")),
    "agpl": ("Affero General Public License", ("3",)),
}
_DEEDS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}


def _gnu() -> list[tuple[str, str]]:
    return [
        (f"{label}-{version}-{kind}", _GNU.format(name=name, grant=grant.format(version=version)))
        for label, (name, versions) in _GNU_VERSIONS.items()
        for version in versions
        for kind, grant in _GRANTS.items()
    ]


def _deeds() -> list[tuple[str, str]]:
    return [(f"cc-{label}-{version}", f"licensed under [a] [the] Creative Commons {name} {version} {{1}} License") for label, name in _DEEDS.items() for version in ("3.0", "4.0")]


#: Label, template.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit-notice", "[this {6} is] released under the [terms of the] mit license"),
    ("apache-notice", "licensed under the apache license version 2 0 [the license]"),
    ("gpl-notice", "licensed under the gnu [lesser] [affero] general public license [as published by the free software foundation] [either] version {1}"),
    ("cc-by-notice", "licensed under [a] [creative commons] [the] cc by [nc] [sa] [nd] {1} 0"),
    ("mit-text", _MIT),
    ("bsd-2-clause", f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("isc", _ISC),
    ("apache-2.0", _APACHE),
    ("mpl-2.0", _MPL),
    *_gnu(),
    *_deeds(),
)
