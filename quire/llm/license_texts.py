"""Wordings of licence headers and licence files, by SPDX identifier, and of short notices.

The texts are the licences' own, whole, with their copyright lines left out where these name a
holder. Of licences of many pages the title and the standard header are here, which are paragraphs
of the file; ``licenses.scan`` takes further (name, text) pairs, such as whole files, as a parameter.
"""

from __future__ import annotations

# Permissive licence texts.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
_MIT_KEEP = """The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
_MIT_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
_BSD_1_2 = """1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""
_APACHE_AS_IS = """Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
_APACHE_ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _gnu(name: str, either: str) -> str:
    return f"""This program is free software{":" if "3" in either else ";"} you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation{either}"""


def _gnu_more(name: str) -> str:
    return f"""This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} for more details."""


def _later(version: str) -> str:
    return f", either version {version} of the License, or\n(at your option) any later version."


_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"

#: (SPDX identifier, text). Whole headers and files first, then their paragraphs, titles and one-line notices.
TEMPLATES = (
    ("MIT", "\n\n".join(("MIT License", _MIT, _MIT_KEEP, _MIT_AS_IS))),
    ("BSD-2-Clause", "\n\n".join(("BSD 2-Clause License", _BSD, _BSD_1_2, _BSD_AS_IS))),
    ("BSD-3-Clause", "\n\n".join(("BSD 3-Clause License", _BSD, _BSD_1_2, _BSD_3, _BSD_AS_IS))),
    ("ISC", "\n\n".join(("ISC License", _ISC, _ISC_AS_IS))),
    ("Apache-2.0", "\n\n".join((_APACHE, "http://www.apache.org/licenses/LICENSE-2.0", _APACHE_AS_IS))),
    ("Apache-2.0", "\n\n".join((_APACHE_ASF, "http://www.apache.org/licenses/LICENSE-2.0", _APACHE_AS_IS))),
    ("GPL-2.0-or-later", "\n\n".join((_gnu(_GPL, "; " + _later("2")[2:]), _gnu_more(_GPL)))),
    ("GPL-3.0-or-later", "\n\n".join((_gnu(_GPL, _later("3")), _gnu_more(_GPL)))),
    ("LGPL-3.0-or-later", "\n\n".join((_gnu(_LGPL, _later("3")), _gnu_more(_LGPL)))),
    ("AGPL-3.0-or-later", "\n\n".join((_gnu(_AGPL, _later("3")), _gnu_more(_AGPL)))),
    ("MIT", _MIT),
    ("MIT", _MIT_KEEP),
    ("MIT", _MIT_AS_IS),
    ("BSD-3-Clause", _BSD),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", _BSD_AS_IS),
    ("ISC", _ISC),
    ("ISC", _ISC_AS_IS),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE_AS_IS),
    ("Apache-2.0", _APACHE_ASF),
    ("MPL-2.0", _MPL),
    ("GPL-2.0-or-later", _gnu(_GPL, "; " + _later("2")[2:])),
    ("GPL-3.0-or-later", _gnu(_GPL, _later("3"))),
    ("LGPL-2.1-or-later", _gnu(_LGPL, "; " + _later("2.1")[2:])),
    ("LGPL-3.0-or-later", _gnu(_LGPL, _later("3"))),
    ("AGPL-3.0-or-later", _gnu(_AGPL, _later("3"))),
    # first lines of headers, as they are wrapped
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without"),
    ("BSD-3-Clause", "modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public"),
    # titles
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    # one-line notices
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal license, dedicated to the public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("proprietary", "All rights reserved."),
    *(
        (name, f"SPDX-License-Identifier: {name}")
        for name in (
            "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
            "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
            "MIT", "MPL-2.0", "Unlicense", "Zlib",
        )
    ),
)
