import sys
from evenkeel.cli import main
sys.exit(main())
