"""Wording of public license texts and of the notices that name them: fixed values."""

from __future__ import annotations

# Notices of one or two sentences.
NOTICES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "Artistic-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-notice": "This software is released under the zlib license.",
    "CC-BY-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-long-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-long-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-notice": "Released into the public domain under CC0 1.0.",
    "CC0-waiver": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty."
    ),
}

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so"
)
_MIT_KEEP = ", subject to the following conditions:"
_MIT_NOTICE = " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = (
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_AS_IS = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)

# Whole texts where they are short, else the header that their authors ask for. An opening is a template of its own:
# files often hold no more than that.
TEXTS: dict[str, str] = {
    "MIT-opening": _MIT_GRANT + _MIT_KEEP,
    "MIT": _MIT_GRANT + _MIT_KEEP + _MIT_NOTICE + _MIT_AS_IS,
    "MIT-0": _MIT_GRANT + "." + _MIT_AS_IS,
    "BSD-opening": _BSD_OPENING,
    "BSD-2-Clause": _BSD_OPENING + _BSD_SOURCE + _BSD_BINARY + _BSD_AS_IS,
    "BSD-3-Clause": _BSD_OPENING + _BSD_SOURCE + _BSD_BINARY + _BSD_NAMES + _BSD_AS_IS,
    "ISC-opening": _ISC_GRANT + _ISC_KEEP,
    "ISC": _ISC_GRANT + _ISC_KEEP + _ISC_AS_IS,
    "0BSD": _ISC_GRANT + "." + _ISC_AS_IS,
    "Apache-2.0-opening": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at"
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-opening": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
        "more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details."
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License "
        "for more details."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "Unlicense-opening": "This is free and unencumbered software released into the public domain.",
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire "
        "statement, including the above license grant, this restriction and the following disclaimer, must be included in all "
        "copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative "
        "works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
        "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
        "but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being "
        "the original software. This notice may not be removed or altered from any source distribution."
    ),
    "WTFPL": (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is "
        "allowed as long as the name is changed."
    ),
}

TEXTS |= {"GPL-2.0-opening": TEXTS["GPL-opening"].replace("version 3", "version 2"), "GPL-2.0": TEXTS["GPL"].replace("version 3", "version 2")}

# Identifiers of licenses, and the names that notices give them.
IDENTIFIERS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
NAMES = {
    "MIT": "MIT", "Apache": "Apache", "BSD": "BSD", "ISC": "ISC", "zlib": "zlib", "BSL-1.0": "Boost Software", "MPL": "Mozilla Public", "EPL": "Eclipse Public", "GPL": "GNU General Public",
    "LGPL": "GNU Lesser General Public", "AGPL": "GNU Affero General Public", "Artistic": "Artistic",
}

SHORT: dict[str, str] = {f"{i}-spdx": f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS} | {f"{i}-field": f"License: {i}" for i in IDENTIFIERS}
SHORT |= {f"{i}-released": f"Released under the {n} License." for i, n in NAMES.items() if i != "MIT"} | {f"{i}-licensed": f"Licensed under the {n} License." for i, n in NAMES.items()}
SHORT |= {f"{i}-software": f"This software is released under the {n} license." for i, n in NAMES.items() if i != "zlib"}
SHORT |= {f"{g}-{v}-or-later-short": f"{g}, version {v} or later" for g in ("GPL", "LGPL", "AGPL") for v in ("2", "2.1", "3")} | {f"GPL-{v}-short": f"GNU GPL v{v}" for v in ("2", "3")}
SHORT |= {"Apache-2.0-short": "Apache License, Version 2.0"}

# Words that tell licenses apart: a notice that lacks one of its template's, or has another's, is not of that license.
NAMING = frozenset(
    "mit apache bsd isc zlib boost bsl mozilla mpl eclipse epl gnu gpl lgpl agpl lesser affero artistic cc creative commons attribution sharealike noncommercial noderivatives unlicense wtfpl".split()
)
CC_PARTS = frozenset("by sa nc nd".split())  # these only beside cc

TEMPLATES = NOTICES | TEXTS | SHORT
