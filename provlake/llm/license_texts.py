"""Licence notices that the scan looks for.

Fixed values: wordings of public licences, in lower case and without signs, as the scan splits words.
"""

from __future__ import annotations

# phrases of the contract: every place counts
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# short notices are found whole; from 20 words on, a few words may differ
NOTICES = [
    ("agpl-3", "gnu affero general public license version 3"),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
                 "you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
              "derived from this software without specific prior written permission"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
              "documentation covered by this license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
            "that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
            "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
              "with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile "
                  "sell or distribute this software"),
]
