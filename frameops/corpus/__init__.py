"""Jobs over tables of questions, SQL, code, error texts and schemas."""
