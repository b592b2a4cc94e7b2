"""attesta.operators.jaccard under the name that this subpackage knows it by."""

import sys

from attesta.operators import jaccard

sys.modules[__name__] = jaccard
