"""What license notices say: full texts of headers and permissions, the names licenses go by, and short identifiers.

Each entry is ``(label, words, least share of its k-grams)``. A share of 1 is for names that differ from another license's
by a word or a number; longer texts are also known with some words changed.
"""

# Permission and header texts as their licenses publish them, in several versions.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", 0.6),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.7),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.7),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", 0.7),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.7),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.7),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.7),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.7),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.7),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", 0.7),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.7),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", 0.7),
    ("apache-2.0", "licensed under the apache license version 2 0", 0.7),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.9),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 0.9),
    ("gpl-3.0", "licensed under the gnu general public license version 3", 1.0),
    ("gpl-2.0", "licensed under the gnu general public license version 2", 1.0),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.9),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", 0.9),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", 0.7),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", 0.7),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.7),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", 0.7),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", 0.7),
    ("mit", "released under the mit license", 0.7),
    ("cc-by-nc", "licensed under cc by nc 4 0", 0.7),
    ("cc-by-sa", "licensed under cc by sa 4 0", 0.7),
)

# Names that stand for a license wherever they stand.
NAMES = (
    ("agpl-3.0", "gnu affero general public license"),
    ("apache-2.0", "apache license version 2 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 international"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0 international"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc0", "cc0 1 0 universal"),
    ("epl-2.0", "eclipse public license version 2 0"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2.0", "mozilla public license version 2 0"),
)

# Short identifiers behind ``SPDX-License-Identifier:``, with their labels.
IDENTIFIERS = {
    "AGPL-3.0-only": "agpl-3.0", "AGPL-3.0-or-later": "agpl-3.0", "Apache-2.0": "apache-2.0", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd",
    "CC-BY-4.0": "cc-by-4.0", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-NC-ND-4.0": "cc-by-nc-nd", "CC-BY-NC-SA-4.0": "cc-by-nc-sa", "CC-BY-ND-4.0": "cc-by-nd",
    "CC-BY-SA-4.0": "cc-by-sa", "CC0-1.0": "cc0", "EPL-2.0": "epl-2.0", "GPL-2.0-only": "gpl-2.0", "GPL-2.0-or-later": "gpl-2.0",
    "GPL-3.0-only": "gpl-3.0", "GPL-3.0-or-later": "gpl-3.0", "ISC": "isc", "LGPL-2.1-only": "lgpl", "LGPL-2.1-or-later": "lgpl",
    "LGPL-3.0-only": "lgpl", "LGPL-3.0-or-later": "lgpl", "MIT": "mit", "MPL-2.0": "mpl-2.0", "Unlicense": "unlicense",
}
