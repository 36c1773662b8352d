"""Jobs that run the library on stored tables; each file has a function of a session and a command line."""
