import sys

from needlebed.cli import main

sys.exit(main())
