import sys

from ocellus.cli import main

sys.exit(main())
