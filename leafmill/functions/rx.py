"""Character classes that mean the same in every engine: JavaScript's white space is wider than Java's."""

#: members of the white-space class of ECMAScript, for use inside [...]
SPACE = r" \t\n\x0B\f\r   -     　﻿"
SPACES = f"[{SPACE}]+"
#: the same as literal characters, for engines that trim by a set of characters
SPACE_CHARS = " \t\n\x0b\f\r                 　﻿"
TRIM = f"^[{SPACE}]+|[{SPACE}]+$"
#: ASCII word boundaries, as JavaScript's \b has them without the u flag
EDGE_LEFT = r"(?<![A-Za-z0-9_])"
EDGE_RIGHT = r"(?![A-Za-z0-9_])"
