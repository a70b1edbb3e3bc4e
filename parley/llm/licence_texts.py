"""Licence templates (public notices) as plain words. Fixed values."""

from itertools import product

#: Elements of the Creative Commons licences: code and the spellings of the
#: long notices.
_CODES: dict[str, list[str]] = {
    "nc": ["NonCommercial", "Non Commercial"],
    "sa": ["ShareAlike", "Share Alike"],
    "nd": ["NoDerivatives", "NoDerivs", "No Derivatives", "No Derivs", "No Derivative Works"],
}


def _creative_commons() -> list[tuple[str, str]]:
    """Short and long notices of the six attribution licences."""
    out = []
    for codes in ((), ("sa",), ("nd",), ("nc",), ("nc", "sa"), ("nc", "nd")):
        label = "-".join(("cc-by", *codes))
        out.append((label, f"Licensed under CC {'-'.join(('BY', *map(str.upper, codes)))} 4.0."))
        for names in product(*(_CODES[c] for c in codes)):
            out.append((label, f"This work is licensed under a Creative Commons {'-'.join(('Attribution', *names))} 4.0 International License."))
    return out


TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
     software and associated documentation files (the "Software"), to deal in the Software without
     restriction, including without limitation the rights to use, copy, modify, merge, publish,
     distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
     Software is furnished to do so, subject to the following conditions: The above copyright notice
     and this permission notice shall be included in all copies or substantial portions of the
     Software."""),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
     file except in compliance with the License. You may obtain a copy of the License at
     http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
     writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
     WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
     language governing permissions and limitations under the License."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms
     of the GNU General Public License as published by the Free Software Foundation, either version 3
     of the License, or (at your option) any later version. This program is distributed in the hope
     that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
     MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
     details."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are
     permitted provided that the following conditions are met: Redistributions of source code must
     retain the above copyright notice, this list of conditions and the following disclaimer.
     Redistributions in binary form must reproduce the above copyright notice, this list of conditions
     and the following disclaimer in the documentation and/or other materials provided with the
     distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
     without fee is hereby granted, provided that the above copyright notice and this permission notice
     appear in all copies."""),
    *_creative_commons(),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

#: Base phrases and their labels.
PHRASES: list[tuple[str, str]] = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

#: Words that state an element of an attribution licence. A notice has the
#: label whose elements are exactly those that it states.
ELEMENTS: list[tuple[str, str]] = [
    ("attribution", "by"), ("cc by", "by"), ("commons by", "by"), *((f"by {c}", "by") for c in _CODES),
    *((words, c) for c, names in _CODES.items() for words in (c, *names)),
]
