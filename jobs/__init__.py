"""Jobs that users run: each has a function taking a session, a command line and a small configuration file."""
