"""Texts of licences and the notices that name them, as their authors publish them (short licences whole, long ones by the notice and
the passages that files carry). Words count only, so punctuation and case don't matter."""

from __future__ import annotations

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

_ISC_DENIAL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_OPENING = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met:"""

_BSD_SOURCE = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""

_BSD_BINARY = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""

_BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""

_BSD_DENIAL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str) -> list[str]:
    """The notice of the GNU licences, in its two common forms."""
    return [
        f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as
        published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.""",
        f"""This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as
        published by the Free Software Foundation; version {version} of the License.""",
        f"licensed under the GNU {name} General Public License version {version}",
        f"GNU {name} General Public License v{version}",
    ]


def _commons(name: str, version: str) -> list[str]:
    return [f"This work is licensed under a Creative Commons {name} {version} International License", f"licensed under the Creative Commons {name} {version} International License"]


TEMPLATES: dict[str, list[str]] = {
    "0bsd": [_ISC_GRANT + ". " + _ISC_DENIAL],
    "afl-3": ["Licensed under the Academic Free License version 3.0"],
    "agpl-3": _gnu("Affero", "3"),
    "apache-2": [
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at""",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
        """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive,
        no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform,
        sublicense, and distribute the Work and such Derivative Works in Source or Object form.""",
    ],
    "artistic-2": [
        """This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0""",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    ],
    "bsd": [_BSD_OPENING, _BSD_SOURCE, _BSD_BINARY, _BSD_NAMES, _BSD_DENIAL],
    "bsl-1": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
        derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "cc-by": _commons("Attribution", "4.0") + ["licensed under CC BY 4.0"],
    "cc-by-nc": [*_commons("Attribution-NonCommercial", "4.0"), "licensed under CC BY NC 4.0"],
    "cc-by-nc-sa": [*_commons("Attribution-NonCommercial-ShareAlike", "4.0"), "licensed under CC BY NC SA 4.0"],
    "cc-by-nd": [*_commons("Attribution-NoDerivatives", "4.0"), "licensed under CC BY ND 4.0"],
    "cc-by-sa": [*_commons("Attribution-ShareAlike", "4.0"), "licensed under CC BY SA 4.0"],
    "cc0": [
        """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the
        public domain worldwide. This software is distributed without any warranty.""",
        "CC0 1.0 Universal Public Domain Dedication",
    ],
    "cddl-1": [
        """The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this
        file except in compliance with the License.""",
    ],
    "epl-2": [
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available
        at""",
    ],
    "eupl-1": [
        """Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL""",
    ],
    "gpl-2": _gnu("", "2"),
    "gpl-3": _gnu("", "3"),
    "isc": [_ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_DENIAL],
    "lgpl-2": _gnu("Lesser", "2.1"),
    "lgpl-3": _gnu("Lesser", "3"),
    "mit": [
        "Released under the MIT License",
        _MIT_GRANT,
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _AS_IS,
    ],
    "mpl-2": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at""",
    ],
    "ncsa": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.",
        "Neither the names of the development group, nor the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission.",
    ],
    "ofl-1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "postgresql": [
        """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written
        agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all
        copies.""",
    ],
    "python-2": [
        """hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly,
        prepare derivative works, distribute, and otherwise use Python alone or in any derivative version""",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
        """In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
        intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
        law.""",
    ],
    "wtfpl": [
        """This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or
        modify it under the terms of the Do What The Fuck You Want To Public License""",
    ],
    "x11": ["Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software.""",
        """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
        it freely, subject to the following restrictions:""",
        """The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
        in a product, an acknowledgment in the product documentation would be appreciated but is not required.""",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
}
