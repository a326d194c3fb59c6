"""Template markup of licences and of the notices by which a file states one, in their publishers' wording.

Fixed values: the wording of the licences. Markup: see ``licenses``. Case and punctuation don't matter. A template starts
with a word of its own: titles, copyright lines and programs' names before it would be optional or replaceable, decide
nothing, and have the automata start at every word."""

_FSF = "the <<beginOptional>>terms of the<<endOptional>>"

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal"
       " in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
       " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
       " The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or"
       " substantial portions of the Software."
       " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,"
       " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;2..20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN"
       " ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE")

ISC = ("Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,"
       " provided that the above copyright notice and this permission notice appear in all copies."
       " THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;2..10>> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED"
       " WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;2..10>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY"
       " DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR"
       " IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE")

_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
             " <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
             " <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
             " in the documentation and/or other materials provided with the distribution.")
_BSD_TAIL = (" THIS SOFTWARE IS PROVIDED BY <<var;1..12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF"
             " MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;1..12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
             " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;"
             " OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR"
             " OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE")
BSD_2 = _BSD_HEAD + _BSD_TAIL
BSD_3 = (_BSD_HEAD + " <<beginOptional>>3<<endOptional>> Neither the name of <<var;1..14>> nor the names of its contributors may be used to endorse or promote products derived"
         " from this software without specific prior written permission." + _BSD_TAIL)

APACHE_HEADER = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
                 " You may obtain a copy of the License at <<var;1..1>>://www.apache.org/licenses/LICENSE-2.0"
                 " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
                 " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and"
                 " limitations under the License")

MPL_HEADER = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,"
              " <<beginOptional>>you can obtain one at <<var;1..1>> <<beginOptional>>www<<endOptional>> mozilla.org/MPL/2.0<<endOptional>>")


def _gnu(kind: str) -> str:
    return ("is free software: you can redistribute it and/or modify it"
            f" under the terms of the GNU {kind} as published by the Free Software Foundation, either version <<var;1..2>> of the License,"
            " or (at your option) any later version")


TEMPLATES = {
    # Whole licences.
    "MIT": MIT, "ISC": ISC, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3,
    # Notices of files under longer licences.
    "Apache-2.0-header": APACHE_HEADER, "MPL-2.0-header": MPL_HEADER,
    "GPL-header": _gnu("General Public License"), "LGPL-header": _gnu("Lesser General Public License"),
    "AGPL-header": _gnu("Affero General Public License"),
    # Lines that name a licence.
    "mit-notice": "<<beginOptional>>this <<var;1..4>> is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>>"
                  f" under {_FSF} mit license",
    "apache-2.0-notice": "licensed under the apache license version 2.0 <<beginOptional>>the license<<endOptional>>",
    "gpl-notice": f"<<beginOptional>>this <<var;1..4>> is<<endOptional>> licensed under {_FSF} gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>>"
                  " general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version <<var;1..1>>",
    "mpl-notice": f"licensed under {_FSF} mozilla public license <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> <<var;1..1>> 0",
    "cc-by-notice": "<<beginOptional>>licensed<<endOptional>> under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by"
                    " <<beginOptional>>nc<<endOptional>> <<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>> <<var;1..1>> 0",
}
