import sys

from scrollmine.cli import main

sys.exit(main())
