"""Entire licence texts, as published, without their copyright lines.

Paragraphs are lines here; how a text is wrapped does not matter to its canonical form.
"""

from __future__ import annotations

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n\n" + _WARRANTY)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted")
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_ISC_TERMS = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC = _ISC_GRANT + _ISC_TERMS + "\n\n" + _ISC_WARRANTY
_ZERO_BSD = _ISC_GRANT + ".\n\n" + _ISC_WARRANTY

_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n\n")
_BSD_SOURCE = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n")
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n\n")
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n\n")
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
# Conditions come as numbers or as bullets, which are punctuation.
_BSD2, _BSD2_BULLETS = (
    f"{_BSD_GRANT}{one}{_BSD_SOURCE}{two}{_BSD_BINARY}{_BSD_WARRANTY}" for one, two in (("1. ", "2. "), ("* ", "* ")))
_BSD3, _BSD3_BULLETS = (
    f"{_BSD_GRANT}{one}{_BSD_SOURCE}{two}{_BSD_BINARY}{three}{_BSD_NAMES}{_BSD_WARRANTY}"
    for one, two, three in (("1. ", "2. ", "3. "), ("* ", "* ", "* ")))

_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
    "compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest "
    "in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of "
    "our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
    "future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
    "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution.")
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n\n"
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the '
    "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
    "so, all subject to the following:\n\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
    "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the "
    "Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
    "language processor.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR "
    "ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")

# Headers that stand in files for a longer licence.
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
    "language governing permissions and limitations under the License.")
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
    "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")


def _gnu_header(name: str, version: str, later: bool) -> str:
    """The header of a GNU licence, which names itself three times."""
    under = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        f"{name} as published by the Free Software Foundation, {under}.\n\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
        f"of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n\n"
        f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>.")


GENERAL, LESSER, AFFERO = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"

# (license, text). A licence with a title is known with it and without.
TEXTS = (
    ("MIT", "MIT License\n\n" + _MIT), ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + _ISC), ("ISC", _ISC),
    ("0BSD", "BSD Zero Clause License\n\n" + _ZERO_BSD), ("0BSD", _ZERO_BSD),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2), ("BSD-2-Clause", _BSD2),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2_BULLETS), ("BSD-2-Clause", _BSD2_BULLETS),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD3), ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD3_BULLETS), ("BSD-3-Clause", _BSD3_BULLETS),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("Zlib", "zlib License\n\n" + _ZLIB), ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0", _APACHE_HEADER), ("MPL-2.0", _MPL_HEADER),
    ("GPL-3.0-only", _gnu_header(GENERAL, "3", False)), ("GPL-3.0-or-later", _gnu_header(GENERAL, "3", True)),
    ("GPL-2.0-only", _gnu_header(GENERAL, "2", False)), ("GPL-2.0-or-later", _gnu_header(GENERAL, "2", True)),
    ("LGPL-3.0-only", _gnu_header(LESSER, "3", False)), ("LGPL-3.0-or-later", _gnu_header(LESSER, "3", True)),
    ("AGPL-3.0-only", _gnu_header(AFFERO, "3", False)), ("AGPL-3.0-or-later", _gnu_header(AFFERO, "3", True)),
)
