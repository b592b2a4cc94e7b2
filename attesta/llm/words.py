"""attesta.functions.words under the name that this subpackage knows it by."""

import sys

from attesta.functions import words

sys.modules[__name__] = words
