import sys

from vitrine.cli import main

sys.exit(main())
