import sys

from spotloom.cli import main

sys.exit(main())
