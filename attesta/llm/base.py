"""attesta.sources.scratch under the name that this subpackage knows it by."""

import sys

from attesta.sources import scratch

sys.modules[__name__] = scratch
