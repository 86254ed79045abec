"""Where the driver's tables lie."""

import os

SMALL = "/root/testdata/sf0.001"
PRESENT = os.path.isdir(SMALL)
