"""Public licence texts and notices by which licences are recognised. Fixed values."""

from __future__ import annotations

_MIT_GRANT = """permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished
to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all
copies or substantial portions of the software."""
_MIT_WARRANTY = """the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright
holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out
of or in connection with the software or the use or other dealings in the software."""
_BSD_1 = """redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
_BSD_2 = """redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_USE = """redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_BSD_WARRANTY = """this software is provided by the copyright holders and contributors "as is" and any express or implied warranties,
including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no
event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or
consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or
business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including
negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""
_ISC_GRANT = """permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_NOTICE = """, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """the software is provided "as is" and the author disclaims all warranties with regard to this software including all
implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or
consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract,
negligence or other tortious action, arising out of or in connection with the use or performance of this software."""


def _gnu(name: str, version: str) -> str:
    """The notice of a licence of the GNU family."""
    return f"""this program is free software: you can redistribute it and/or modify it under the terms of the gnu {name} public license as
published by the free software foundation, either version {version} of the license, or (at your option) any later version. this program is
distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or
fitness for a particular purpose. see the gnu {name} public license for more details."""


#: (text, label): whole licences where they are short, else the notice that their authors ask for, and common one-line forms.
TEMPLATES = (
    (f"{_MIT_GRANT} {_MIT_WARRANTY}", "mit"),
    (f"{_ISC_GRANT}{_ISC_NOTICE} {_ISC_WARRANTY}", "isc"),
    (f"{_ISC_GRANT}. {_ISC_WARRANTY}", "0bsd"),
    (f"{_BSD_USE} {_BSD_1} {_BSD_2} {_BSD_WARRANTY}", "bsd-2"),
    (f"{_BSD_USE} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_WARRANTY}", "bsd-3"),
    ("""this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any
    damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including
    commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: the origin of this
    software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a
    product, an acknowledgment in the product documentation would be appreciated but is not required. altered source versions must be
    plainly marked as such, and must not be misrepresented as being the original software. this notice may not be removed or
    altered from any source distribution.""", "zlib"),
    ("""permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
    documentation covered by this license (the "software") to use, reproduce, display, distribute, execute, and transmit the software,
    and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all
    subject to the following: the copyright notices in the software and this entire statement, including the above license grant, this
    restriction and the following disclaimer, must be included in all copies of the software, in whole or in part, and all derivative
    works of the software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
    a source language processor.""", "bsl-1"),
    ("""this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile,
    sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
    non-commercial, and by any means. in jurisdictions that recognize copyright laws, the author or authors of this software dedicate
    any and all copyright interest in the software to the public domain.""", "unlicense"),
    ("""everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as
    long as the name is changed.""", "wtfpl"),
    ("""licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license.
    you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to
    in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any
    kind, either express or implied. see the license for the specific language governing permissions and limitations under the
    license.""", "apache-2"),
    (_gnu("general", "2"), "gpl-2"),
    (_gnu("general", "3"), "gpl-3"),
    (_gnu("lesser general", "2.1"), "lgpl-2.1"),
    (_gnu("lesser general", "3"), "lgpl-3"),
    (_gnu("affero general", "3"), "agpl-3"),
    ("""this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with
    this file, you can obtain one at http://mozilla.org/mpl/2.0/.""", "mpl-2"),
    ("""this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is
    available at https://www.eclipse.org/legal/epl-2.0/""", "epl-2"),
    ("this work is licensed under a creative commons attribution 4.0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution-sharealike 4.0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution-noncommercial 4.0 international license", "cc-by-nc"),
    ("""the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to
    the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.""", "cc0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
