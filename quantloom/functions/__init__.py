"""Pure column builders."""
