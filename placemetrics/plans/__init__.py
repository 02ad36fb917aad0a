"""The report's blocks as functions over harmonised respondents and traffic sheets."""
