"""Pure Column functions and window builders."""
